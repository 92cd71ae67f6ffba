"""Plans under skew: one key holds a third of the rows or more."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F
from tests.payments import build, linked

from payrecon.operators import gateways as g, lifecycle as lc
from payrecon.operators.duplicates import FLAG, flag_duplicates
from payrecon.operators.selection import distinct_orders
from payrecon.plans import payment_view as pv
from payrecon.plans.options import QueryOptions

@pytest.fixture(autouse=True)
def generated_code(spark):
    """These tests run the code that the product runs."""
    keys = ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")
    old = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "true")
    spark.conf.set(keys[1], "FALLBACK")
    yield
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def small(spark):
    """Thresholds at which a few megabytes behave like a few terabytes."""
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def hot_payments(spark, n=20000):
    """Card rows of which a third belong to one payment; every row carries text that does not compress."""
    hot = F.col("id") % 3 == 0
    order = F.when(hot, 1).otherwise(F.col("id") + 2)
    rows = spark.range(n, numPartitions=8).select(
        order.alias("order_id"), F.concat(F.lit("p"), order).alias("payment_online_transaction_id"),
        F.when(F.col("id") == 0, "Authorisation").otherwise("Capture").alias("status"), F.lit("10000").alias("response_code"),
        F.lit("5.00").cast("decimal(18,2)").alias("transaction_amount"), F.concat(F.lit("r"), F.col("id")).alias("rrn"),
        F.sha2(F.col("id").cast("string"), 512).alias("issuing_bank"))
    tables = build(spark, **linked(1))
    tables["checkout_v1"] = tables["checkout_v1"].unionByName(rows, allowMissingColumns=True)
    return tables


def test_hot_payment_is_split_in_facts_and_link_joins(small):
    tables = hot_payments(small)
    df = pv.transactions(tables, QueryOptions(flavour="script"))[0]
    got = df.groupBy("final_rrn", "transaction_analysis").agg(F.count(F.lit(1)).alias("n"), F.max("checkout_v1_issuing_bank"))
    rows = got.collect()
    assert [(r["final_rrn"], r["n"]) for r in rows] == [("r0", 20000 // 3)]
    assert "skew=true" in plan(got)


def test_hot_duplicate_group_is_split(small):
    df = small.range(30000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"), F.lit(1).alias("b"),
        F.sha2(F.col("id").cast("string"), 512).alias("payload"))
    out = flag_duplicates(df, ("a", "b")).groupBy(FLAG).agg(F.count(F.lit(1)).alias("n"), F.max("payload"))
    assert {r[FLAG]: r["n"] for r in out.collect()} == {True: 10000, False: 20000}
    assert "skew=true" in plan(out)


def test_nothing_gathers_a_group(spark):
    tables = build(spark, **linked(1))
    frames = [
        pv.payment_view(tables),
        lc.auth_capture_groups(g.gateway_rows(tables)),
        flag_duplicates(tables["bank"], ("rrn", "status"), ("card_type",)),
        distinct_orders(pv.transactions(tables)[0]),
    ]
    for df in frames:
        text = plan(df)
        for word in ("Window", "Python", "CartesianProduct", "BroadcastNestedLoopJoin", "collect_list", "SinglePartition"):
            assert word not in text, word
        assert "partial_" in text or "HashAggregate" in text


def test_filters_and_columns_reach_the_scans(spark):
    from payrecon.plans.query import payment_query
    from standin import payment_tables

    tables = payment_tables(spark, "/root/testdata/sf0.001")
    options = QueryOptions(include_reconciliation=False, date_range=("1995-01-01", "1995-12-31"))
    text = plan(payment_query(tables, [], options))
    portal = [line for line in text.splitlines() if "o_orderdate" in line and "FileScan" in line]
    assert portal and all("PushedFilters" in line and "o_orderdate" in line.split("PushedFilters")[1] for line in portal)
    assert "c_name" not in text and "l_comment" not in text


def test_bucketed_tables_join_without_a_shuffle(spark):
    from payrecon.plans import ingest as ing
    from payrecon.sources.spec import default_spec

    tables = build(spark, **linked(1, 2, 3))
    loaded = {}
    for name in ("portal", "metabase"):
        rows = tables[name].withColumns({"data_source": F.lit(name), "processed_at": F.lit("2024-01-01").cast("timestamp")})
        report = ing.load_table(rows, default_spec(name), bucket_by=ing.JOIN_KEYS[name], buckets=4)
        assert report.verified and report.rows == 3
        loaded[name] = spark.table(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = g.order_links(loaded["metabase"], loaded["portal"])
        assert links.count() == 3
        assert "Exchange" not in plan(links)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in loaded:
            spark.sql(f"DROP TABLE {name}")


def test_files_that_compress_well_are_not_broadcast(spark, tmp_path):
    """A table of constant columns is a few kilobytes on disk and tens of megabytes in memory; the driver never gets it."""
    path = str(tmp_path / "bank")
    spark.range(200_000, numPartitions=1).select(
        F.lit(1).alias("k"), *[F.lit("x" * 200).alias(f"c{i}") for i in range(3)]).write.parquet(path)
    rows = spark.read.parquet(path)
    df = spark.range(10).join(rows, F.col("id") == F.col("k")).groupBy().agg(F.max("c0"), F.max("c1"), F.max("c2"))
    assert df.collect()[0][0] == "x" * 200
    # As it ran, the large side is never the one that is broadcast.
    text = plan(df).split("Initial Plan")[0]
    for chunk in text.split("BroadcastExchange")[1:]:
        assert "FileScan" not in chunk.split("+- ")[-1] or "c0" not in chunk


def staged_plan(module, name, run) -> str:
    """The plan of the frame that is staged under a name."""
    texts, real = {}, module.staged
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(module, "staged", lambda df, n: texts.setdefault(n, plan(df)) and real(df, n))
        run()
    return texts[name]


def test_funnel_links_the_gateways_once(spark):
    text = staged_plan(pv, "funnel", lambda: pv.stage_funnel(build(spark, **linked(1))))
    assert text.count("Join") <= 6


def test_groups_that_meet_are_summed_where_the_join_left_them(small):
    from payrecon.operators import reconcile as rc

    text = staged_plan(rc, "met", lambda: pv.match_summary(build(small, **linked(1))))
    assert "Exchange" not in text.split("SortMergeJoin")[0]


def test_shuffles_begin_with_many_partitions(spark):
    assert ", 1000)" in plan(spark.range(10).groupBy((F.col("id") % 7).alias("k")).count())


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_shuffles_of_a_staged_frame_are_gone_when_it_is_there(spark):
    import time

    from payrecon.session import staged

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key)
    rows = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):  # executors are told without waiting for them
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and rows.count() == 7 and spark.conf.get(key) == setting


def test_matches_of_one_day_are_counted_after_those_of_any_day(spark):
    from payrecon.operators import reconcile as rc

    rows = [{"order": o, "pay": f"p{o}", "auth": f"a{o}", "rrn": f"r{o}", "status": "Capture"} for o in (1, 2)]
    tables = build(spark, **linked(1, 2), checkout_v1=rows, bank=[{"auth": "a1", "rrn": "x"}, {"auth": "a2", "rrn": "r2"}])
    kinds, real = [], rc.staged
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rc, "staged", lambda df, n: kinds.append(n) or real(df, n))
        got = pv.match_summary(tables, QueryOptions(flavour="script", auth_only_match=False)).collect()
        assert kinds == ["signatures", "met", "met"]
    assert sorted((r["bank_match_type"], r["n_rows"]) for r in got) == [
        ("FALLBACK MATCH: Authorization Code + Same Day + Amount", 1), ("MATCH: Authorization Code + RRN + Amount", 1)]
