"""Every opN_ query over the smallest tables: one row for each of its table, or for each query, and its columns."""

from flowquarry.llm import queries


def test_queries_return_whole_tables(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet").count(), spark.read.parquet(f"{sf}/pages.parquet").count()
    rows = {"op1_sentencepiece": docs, "op2_language_id": docs, "op5_secrets": docs, "op7_line_dedup": docs, "op8_jaccard": docs, "op9_warc": pages, "op10_quality": docs}
    columns = {
        "op2_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op3_ann": {"query_id", "rank", "vec_id", "score"}, "op4_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op5_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, "op6_topk": {"query_id", "rank", "vec_id", "score"}, "op8_jaccard": {"doc_id", "n_shingles", "component_id"},
        "op9_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "op10_quality": {"doc_id", "held_out", "score", "predicted"},
    }
    for name, f in queries.QUERIES.items():
        got = f(spark, sf)
        assert columns.get(name, set()) <= set(got.columns), name
        n = got.count()
        assert n == rows.get(name, n) and n > 0, name
