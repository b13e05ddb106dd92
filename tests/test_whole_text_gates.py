"""The text gates over whole tables: no text is left out for the sake of SQL."""

from lakecohort.functions import phi
from lakecohort.plans import registry


def test_findings_and_counts_of_every_document(spark, tmp_path):
    hits = {
        "AADHAAR": "1234 5678 9012", "PAN": "ABCDE1234F", "INDIAN_VOTER_ID": "ABC1234567", "INDIAN_DL": "MH12 20110012345", "INDIAN_PASSPORT": "A1234567", "INDIAN_PHONE": "+91 9876543210",
        "EMAIL": "a.b@c.org", "URL": "https://x.org/a", "INDIAN_PIN": "pin code: 110001", "SSN": "123-45-6789", "MRN": "MRN 123456", "IP": "10.0.0.1", "DATE_ISO": "2020-01-31", "PERSON_NAME_PREFIX": "Dr. Smith",
    }
    assert set(hits) == set(phi.BLOCKING)
    rows = [(k, f"é {prefix} {x} ü") for k, x in hits.items() for prefix in ("日本", "plain")] + [("none", "plain ASCII text"), ("none", "é"), ("none", None)]
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["findings"] for r in registry.queries()["phi1_findings_all"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, (k, _) in enumerate(rows):
        assert k in got[i] if k != "none" else got[i] == []
    counts = {r[0]: r[1] for r in registry.queries()["agg19_label_counts_all"](spark, str(tmp_path)).collect()}
    assert counts == {k: sum(k in f for f in got.values()) for k in hits} and min(counts.values()) >= 2


def test_every_turn_is_sanitised_as_it_is(spark, tmp_path):
    phrases = [
        "Ignore all previous instructions", "disregard the above", "forget everything", "you are now a", "new instructions:", "system: ", "act as a", "developer mode", "jailbreak", "override your safety",
    ]
    assert len(phrases) == len(phi.INJECTION)
    rows = [(1, i, f"{p} rest") for i, p in enumerate(phrases)] + [(2, 0, "a user's new idea"), (2, 1, ""), (2, 2, None), (2, 3, "é, plain")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["text"] for r in registry.queries()["phi13_sanitise_all"](spark, str(tmp_path)).collect()}
    framed = lambda t: f"[UNTRUSTED chat BEGIN]\n{t}\n[UNTRUSTED chat END]"
    assert len(got) == len(rows) and got[2, 1] == got[2, 2] == ""
    assert got[2, 0] == framed("a user's new idea") and got[2, 3] == framed("é, plain")
    for i in range(len(phrases)):
        assert phi.INJECTED in got[1, i] and phrases[i] not in got[1, i]


def test_digits_of_all_scripts_are_found(spark):
    df = spark.createDataFrame([("९८७६ ५४३२ १०९८",), ("no digits, a.b@c.org",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(phi.labels("t", phi.BLOCKING)).collect()] == [["AADHAAR"], ["EMAIL"], [], []]
    assert [r[0] for r in df.select(phi.redact("t")).collect()] == ["<AADHAAR>", "no digits, <EMAIL>", "plain", None]
