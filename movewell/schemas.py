"""Schemas of the records that enter and leave the engine."""

from pyspark.sql import types as T

# Names and types of the wire record, of gold and of the routing answer are those that others read and write.
ACTIVITY = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("employee_id", T.IntegerType()),
    T.StructField("date_debut", T.LongType()),  # microseconds since the epoch
    T.StructField("type_activite", T.StringType()),
    T.StructField("distance_m", T.DoubleType()),
    T.StructField("duree_s", T.IntegerType()),
    T.StructField("commentaire", T.StringType()),
])

# A change record as it travels on the topic. The connector's own commit time is optional.
ENVELOPE = T.StructType([
    T.StructField("payload", T.StructType([
        T.StructField("op", T.StringType()),
        T.StructField("after", ACTIVITY),
        T.StructField("source", T.StructType([T.StructField("ts_ms", T.LongType())])),
    ])),
])

# The same with what a row was before: of a delete, the only place that names it.
CHANGE_ENVELOPE = T.StructType([
    T.StructField("payload", T.StructType([
        T.StructField("op", T.StringType()),
        T.StructField("before", T.StructType([T.StructField("id", T.IntegerType())])),
        T.StructField("after", ACTIVITY),
    ])),
])

# Columns a message log delivers; a file-based log must be written with the same ones.
MESSAGE = T.StructType([
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("value", T.BinaryType()),
])

BRONZE = T.StructType([*ACTIVITY.fields, T.StructField("date_debut_ts", T.TimestampType())])

# Bronze that keeps what happened and in which order, for tables that follow updates and deletes.
CHANGES = T.StructType([
    T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("op", T.StringType()),
    *BRONZE.fields,
])

GOLD = T.StructType([
    T.StructField("employee_id", T.LongType()),
    T.StructField("bu", T.StringType()),
    T.StructField("prime_sportive", T.BooleanType()),
    T.StructField("montant_prime_euros", T.DoubleType()),
    T.StructField("distance_km", T.DoubleType()),
    T.StructField("nb_activites", T.LongType()),
    T.StructField("jours_bien_etre", T.BooleanType()),
    T.StructField("declaration_correcte", T.BooleanType()),
])

ROUTE_RESPONSE = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("rows", T.ArrayType(T.StructType([
        T.StructField("elements", T.ArrayType(T.StructType([
            T.StructField("status", T.StringType()),
            T.StructField("distance", T.StructType([T.StructField("value", T.LongType())])),
        ]))),
    ]))),
])

# A row of the source table as bulk-loaded; the database assigns the id.
LOADED_ACTIVITY = T.StructType([
    T.StructField("employee_id", T.LongType()),
    T.StructField("date_debut", T.TimestampNTZType()),
    T.StructField("type_activite", T.StringType()),
    T.StructField("distance_m", T.DoubleType()),
    T.StructField("duree_s", T.IntegerType()),
    T.StructField("commentaire", T.StringType()),
])
