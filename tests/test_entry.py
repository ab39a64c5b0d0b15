"""The flagship query over a folder of its own."""

import __spark_entry__


def test_entry_scans_with_all_rules_entropy_and_deep_scan(spark, tmp_path):
    token = "5F4DCC3B5AA765D61D8327DEB882CF99"
    texts = ["BSN: 123456782", "mail a@corp.example.com", f"api.vultr.com\nkey {token}WXYZ", "nothing here"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.veilspan.data", str(tmp_path))
    try:
        got = {r.category: r.docs for r in __spark_entry__.entry(spark).collect()}
    finally:
        spark.conf.unset("spark.veilspan.data")
    assert got.get("PII / Contact") == 1
    assert len(got) >= 3, got  # a rule outside the four once used, and a heuristic
