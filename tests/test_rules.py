import hashlib
import json

import pytest

from movewell.fixed_values import DEFAULT_RULES
from movewell.rules import DEFAULT, Rules, load_rules

YAML = """
prime_sportive:
  percent: 0.08   # of the gross salary
bien_etre:
  min_activities: 12
distance: {max_walk_km: 10, max_bike_km: 20}
"""


def test_yaml_rules_are_typed_and_fingerprinted(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "rules.yml"
    path.write_text(YAML)
    rules, fingerprint = load_rules(str(path))
    assert rules == Rules(0.08, 12, 10.0, 20.0, 365)
    assert isinstance(rules.max_walk_km, float)
    assert fingerprint == hashlib.md5(YAML.encode()).hexdigest()


def test_fingerprint_changes_with_any_byte(tmp_path):
    one, two = tmp_path / "one.json", tmp_path / "two.json"
    one.write_text(json.dumps(DEFAULT_RULES))
    two.write_text(json.dumps(DEFAULT_RULES) + "\n")
    assert load_rules(str(one))[0] == load_rules(str(two))[0] == DEFAULT
    assert load_rules(str(one))[1] != load_rules(str(two))[1]


def test_rules_in_shared_storage_are_read_through_spark(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(DEFAULT_RULES))
    assert load_rules(f"file://{path}", spark) == load_rules(str(path))
