import hashlib

from oracle import differences

from larkspur.llm import exact_dedup, queries


def test_query_equals_sql(spark, sf):
    assert differences(queries.op1_exact_dedup(spark, sf), queries.ORACLE_SQL["op1_exact_dedup"], sf)[1:] == (0, 0)


def test_odd_rows(spark, odd_docs):
    got = exact_dedup.deduplicate(odd_docs, exact_dedup.fresh_index(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == odd_docs.count()
    assert (by[1][0]["kept"], by[2][0]["kept"], by[1][0]["keep_id"], by[1][0]["group_size"]) == (False, True, 2, 2)
    assert by[3][0]["keep_id"] == by[4][0]["keep_id"] == 4
    assert sorted(r["kept"] for r in by[8]) == [False, True]
    assert by[None][0]["kept"]
    assert by[7][0]["text_sha256"] == hashlib.sha256("Ünïcode ÄÖÜ straße naïve 日本語 text".replace("U", "u").encode()).hexdigest()


def test_survivors_keep_all_columns(spark, odd_docs):
    kept = exact_dedup.survivors(odd_docs, exact_dedup.fresh_index(spark))
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["2", "4", "5", "6", "7", "8", "9", "None"])


def test_second_batch_meets_the_index(spark):
    index = exact_dedup.fresh_index(spark)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.deduplicate(docs((1, "a"), (2, "b")), index).collect()
    again = exact_dedup.DigestIndex(spark, index.path)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(docs((3, "A"), (4, "c")), again).collect()}
    assert got == {3: (1, False), 4: (4, True)}
    assert again.rows().count() == 3


def test_empty(spark, no_docs):
    assert exact_dedup.deduplicate(no_docs, exact_dedup.fresh_index(spark)).collect() == []


def test_a_batch_that_is_run_again_gives_the_same_rows(spark):
    index = exact_dedup.fresh_index(spark)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.deduplicate(docs((1, "a"), (2, "b")), index, batch="one").collect()
    second = docs((3, "A"), (4, "c"), (5, "c"), (6, None))
    first_run = sorted(map(tuple, exact_dedup.deduplicate(second, index, batch="two").collect()))
    # The job died after its append and before its result was used.
    assert sorted(map(tuple, exact_dedup.deduplicate(second, index, batch="two").collect())) == first_run
    assert [r[3] for r in first_run] == [False, False, True, True]
    assert index.rows().count() == 4
    assert sorted(map(tuple, exact_dedup.deduplicate(second, index, batch="three").collect())) == [(*r[:3], False, r[4]) for r in first_run]
    kept = exact_dedup.survivors(docs((7, "d"), (8, "a")), index, batch="four")
    assert [r["doc_id"] for r in kept.collect()] == [7]


def test_compacted_index_has_one_file_a_bucket(spark):
    index = exact_dedup.fresh_index(spark)
    for k in range(3):
        exact_dedup.deduplicate(spark.createDataFrame([(k, f"t{k} {i}") for i in range(40)], "doc_id long, text string"), index).collect()
    small = index.compacted(exact_dedup.shared_dir(spark, "compacted"))
    assert sorted(small.rows().collect()) == sorted(index.rows().collect())
    assert len(small.rows().inputFiles()) <= small.buckets < len(index.rows().inputFiles())


def test_a_text_with_most_rows(spark):
    rows = [(i, "the one text" if i % 3 else f"text {i}") for i in range(300)]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), exact_dedup.fresh_index(spark)).collect()
    assert len(got) == 300 and {r["group_size"] for r in got} == {1, 200}
    assert [r["doc_id"] for r in got if r["kept"] and r["group_size"] > 1] == [299]
