"""Receipts, buyer records and the datasheet are JSON as a canonical writer has it, with every field."""

import hashlib
import hmac
import json
from collections import Counter

from parley import catalogue
from parley.operators.provenance import KEY
from parley.plans.dialect import Spark

DIR = "/root/testdata/sf0.001"


def asked(spark, name):
    return catalogue.queries()[name](spark, DIR).collect()


def canonical(x):
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def signed(text):
    return hmac.new(KEY.encode(), text.encode(), hashlib.sha256).hexdigest()


def test_receipts_have_every_field(spark):
    kept = {}
    for r in asked(spark, "final_texts"):
        kept.setdefault(r.conv_id, []).append((r.record_id, r.final_text))
    rows = asked(spark, "consent_receipts")
    assert {r.conv_id for r in rows} == kept.keys()
    for r in rows:
        body = json.loads(r.body)
        assert canonical(body) == r.body and r.signature == signed(r.body)
        assert list(body) == ["receipt_id", "receipt_version", "pattern", "issued_at", "contributor", "scope", "purpose", "authorisation", "disclosures", "jurisdiction", "revocation"]
        assert body["receipt_id"] == r.receipt_ref and body["scope"]["content"] == "prompts-only" and body["revocation"] == {"revocable_while_unsold": True, "revoked_at": None}
        assert body["scope"]["conversation_fingerprints"] == [hashlib.sha256(t.encode()).hexdigest() for _, t in sorted(kept[r.conv_id])]
        assert body["authorisation"]["notify_on_sale"] is True and body["authorisation"]["buyer_categories"] and body["disclosures"]["shown"] and body["jurisdiction"] in ("US", "CA", None)
    assert {json.loads(r.body)["jurisdiction"] for r in rows} == {"US", "CA", None}


def test_buyer_records_and_datasheet(spark):
    refs = {r.receipt_ref for r in asked(spark, "consent_receipts")}
    lines = []
    for r in asked(spark, "buyer_records"):
        line = json.loads(r.line)
        assert canonical(line) == r.line and r.signature == signed(r.line) and line["conversation_id"] == r.conversation_ref
        assert list(line) == ["id", "conversation_id", "language", "prompts", "source", "provenance", "characteristics"] and line["provenance"]["consent_receipt_ref"] in refs
        assert line["characteristics"]["prompt_count"] == len(line["prompts"]) > 0 and "pseu_" not in r.line
        lines.append(line)
    (row,) = asked(spark, "datasheet")
    sheet = json.loads(row.datasheet)
    share = lambda values: {k: int(n / len(lines) * 100 + 0.5) / 100 for k, n in Counter(values).items()}
    assert sheet["composition"] == {"record_count": len(lines), "languages": share(x["language"] for x in lines), "domain_tags": share(x["characteristics"]["domain_tags"][0] for x in lines)}
    assert sheet["batch_id"].endswith(f"_{len(lines):04d}") and sheet["consent"]["revocable"] is True


def test_texts_are_escaped(spark):
    text = 'a "b" \\ c\n\t\r\b\f é\\n'
    rows = spark.createDataFrame([(text, None)], "x string, y string")
    e = Spark("x")
    got = rows.selectExpr(f"{e.json_object({'t': e.json_text('x'), 'n': e.json_text('y'), 'l': e.json_list('array(' + e.json_text('x') + ')')})} AS j").first().j
    assert got == canonical({"t": text, "n": None, "l": [text]})
