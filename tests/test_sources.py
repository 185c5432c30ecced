"""Reading with rejects, writing lines, merging."""

import json

from parley.sources.briefs import read_briefs, seeded, update_where
from parley.sources.prompts import insert_new, read_prompts, upsert, write_lines

GOOD = {"record_id": "r1", "conv_id": "c", "turn": 0, "text": "hello", "exact_hash": "a" * 64, "sim_hash": "b" * 16, "captured_at": 5}


def test_read_prompts(spark, tmp_path):
    bad = {
        "unknown_field": GOOD | {"record_id": "r2", "extra": 1}, "missing_field": GOOD | {"record_id": "r3", "text": None}, "text": GOOD | {"record_id": "r4", "text": "x" * 20_001},
        "turn": GOOD | {"record_id": "r5", "turn": -1}, "exact_hash": GOOD | {"record_id": "r6", "exact_hash": "A" * 64}, "sim_hash": GOOD | {"record_id": "r7", "sim_hash": "b"},
    }
    twice = GOOD | {"record_id": "r8"}
    lines = [json.dumps(x) for x in [GOOD, *bad.values(), twice, twice]] + ["{oops", "", "[1]"]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    valid, rejects = read_prompts(spark, str(tmp_path / "in.jsonl"))
    assert [r.record_id for r in valid.collect()] == ["r1"]
    assert sorted(r.rule for r in rejects.collect()) == sorted([*bad, "duplicate_id", "duplicate_id", "not_json", "not_json"])
    write_lines(valid, str(tmp_path / "out"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [GOOD]


def test_merge(spark):
    stored = spark.createDataFrame([("a", 1, "live"), ("b", 1, "sold")], "id string, v int, status string")
    rows = spark.createDataFrame([("a", 2, "live"), ("b", 9, "live"), ("c", 1, "live")], "id string, v int, status string")
    assert {tuple(r) for r in upsert(stored, rows, ["id"], "v", "status = 'sold'").collect()} == {("a", 2, "live"), ("b", 1, "sold"), ("c", 1, "live")}
    assert {tuple(r) for r in insert_new(stored, rows, ["id"]).collect()} == {("a", 1, "live"), ("b", 1, "sold"), ("c", 1, "live")}


BRIEF = {
    "brief_ref": "b", "spec": {"domains": ["coding"], "languages": ["en"], "keywordsAny": ["x"], "keywordsAll": [], "keywordsNone": [], "minPromptsPerConversation": 2},
    "quality": {"maxRedactionDensity": 0.25, "dedupGuarantee": "exact+near"}, "volume": {"targetConversations": 5, "maxPerContributor": None}, "expiresAt": "2030-01-01T00:00:00Z",
}


def test_read_briefs(spark, tmp_path):
    def changed(part, **new):
        return BRIEF | {part: BRIEF[part] | new} if part else BRIEF | new

    bad = {
        "unknown_field": changed("spec", colour="red"), "missing_field": {k: v for k, v in BRIEF.items() if k != "quality"}, "domains": changed("spec", domains=["cooking"]), "languages": changed("spec", languages=["fr"]),
        "keywords": changed("spec", keywordsAll=["x" * 121]), "min_prompts": changed("spec", minPromptsPerConversation=1001), "density": changed("quality", maxRedactionDensity=1.5), "guarantee": changed("quality", dedupGuarantee="near"),
        "volume": changed("volume", maxPerContributor=0), "expires": changed("", expiresAt="soon"), "expired": changed("", expiresAt="2020-01-01T00:00:00Z"), "empty_lists": changed("spec", domains=[]),
    }
    (tmp_path / "in.jsonl").write_text("\n".join([json.dumps(x) for x in [BRIEF, *bad.values()]] + ["{oops", ""]))
    valid, rejects = read_briefs(spark, str(tmp_path / "in.jsonl"), "2026-01-01")
    assert [r.spec.keywordsAny for r in valid.collect()] == [["x"]]
    assert sorted(r.rule for r in rejects.collect()) == sorted([*bad, "not_json"])


def test_update_where_and_seed(spark):
    stored = spark.createDataFrame([("a", "reserved", 1), ("b", "transferred", 2), ("c", "reserved", 3)], "id string, status string, cents long")
    changes = spark.createDataFrame([("a", "cancelled"), ("b", "cancelled"), ("z", "cancelled")], "id string, status string")
    assert {tuple(r) for r in update_where(stored, changes, ["id"], "status = 'reserved'").collect()} == {("a", "cancelled", 1), ("b", "transferred", 2), ("c", "reserved", 3)}
    users, briefs = spark.createDataFrame([], "email string, role string"), spark.createDataFrame([], "brief_ref string, buyer string, status string")
    once = seeded(users, briefs)
    twice = seeded(*once)
    assert [sorted(map(tuple, t.collect())) for t in once] == [sorted(map(tuple, t.collect())) for t in twice] and once[0].count() == 2 and once[1].count() == 1
