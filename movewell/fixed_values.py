"""Words, headers, limits and texts that results must carry exactly as given."""

# Activity types of the source system and its two special rows.
ACTIVITY_TYPES = ("course à pied", "vélo", "marche", "randonnée", "escalade")
MARKER_TYPE = "BACKFILL_COMPLETE"
MARKER_EMPLOYEE_ID = 0
MARKER_COMMENT = "--- FIN DU BACKFILL POC ---"
PROBE_EMPLOYEE_ID = 999999999
PROBE_COMMENT = "Session de test unique"

# Transport modes that can earn the commute bonus.
WALK_MODE = "Marche/running"
BIKE_MODE = "Vélo/Trottinette/Autres"

# Headers of the HR sheet.
HR_ID = "ID salarié"
HR_UNIT = "BU"
HR_MODE = "Moyen de déplacement"
HR_SALARY = "Salaire brut"
HR_DISTANCE = "distance_km"
HR_ADDRESS = "Adresse du domicile"

# Fixed value: the name under which SQL clients find gold.
GOLD_VIEW = "gold_eligibilites"

# The business rules in force when no rules file is given.
DEFAULT_RULES = {
    "prime_sportive": {"percent": 0.05},
    "bien_etre": {"min_activities": 15, "window_days": 365},
    "distance": {"max_walk_km": 15, "max_bike_km": 25},
}

# Ranges of generated activities.
GENERATED_PER_EMPLOYEE = (10, 25)
GENERATED_DAYS = 365
GENERATED_METRES = (800, 20000)
GENERATED_SECONDS = (600, 7200)

# Notification text; the names in braces are columns.
NOTIFICATION_LINES = (
    "*Nouvelle activité sportive !* :runner:",
    "> *Employé* : `{employee_id}`",
    "> *Type*    : *{type_activite}*",
    "> *Distance*: {distance_m} m",
    "> *Durée*   : {duree_s} s",
    "> *Date*    : {date}",
)

# Dashboard threshold steps as (lower bound, colour); None is the base colour.
UP_STEPS = ((None, "green"), (0, "dark-red"), (1, "green"))
RATE_STEPS = ((None, "green"), (80, "red"))
ERROR_STEPS = ((None, "green"), (1, "red"))
