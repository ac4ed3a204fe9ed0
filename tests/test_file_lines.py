"""The line source over all documents, by brute force."""

from collections import Counter

from quarry.plans import catalog


def test_every_line_of_every_document(spark, tmp_path):
    texts = ["one\ntwo", "", None, "\n", "x" * 50 + "\n\nshort\n", "a\r\nb", "x" * 41]
    docs = [(i, texts[i % len(texts)], "web") for i in range(45)] + [(3, "again", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["all_file_lines"](spark, str(tmp_path)).collect()
    name = lambda i: f"src/web/{ {0: 'tests/', 1: 'vendor/'}.get(i % 10, '') }d{i}.{['py', 'go', 'js', 'md'][i % 4]}"
    want = Counter((name(i), n, line) for i, t, _ in docs for n, line in enumerate((t or "").split("\n"), 1))
    assert Counter(map(tuple, got)) == want and len({r["path"] for r in got}) == 45
