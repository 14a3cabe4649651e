import threading
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import dense_ids, softplus
from tidemark.operators import cleanse, core, edges, layers, masks, objectives, profile, quality, ranking, sampling, split
from tidemark.plans import catalog
from tidemark.plans.pipeline import Pipeline, main
from tidemark.settings import Settings, cutoff
from tidemark.sources.readers import RAW, read_profile_csv, read_raw_csv

S = Settings(train_end="2024-01-20", val_end="2024-01-25", min_user=1, min_item=1)
T1, T2 = S.train_cut, S.val_cut
RAWS = "user_id long, product_id long, event_type string, event_time timestamp, price double, category_code string, brand string, user_session string"


def at(seconds, micros=0):
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None, microsecond=micros)


def row(user, product, kind, ts, category="a.b.c", brand="B", session="s", price=1.0):
    return (user, product, kind, at(ts) if isinstance(ts, int) else ts, price, category, brand, session)


def frame(spark, rows):
    return spark.createDataFrame(rows, RAWS)


def test_settings():
    assert cutoff("2024-01-20") == T1 == 1705795200 and T2 == 1706227200
    with pytest.raises(ValueError):
        Settings(train_end="2024-01-25", val_end="2024-01-25")
    with pytest.raises(ValueError):
        Settings(target="wish")


def test_cleaning(spark):
    rows = [row(None, 1, "view", 5), row(1, None, "view", 5), row(1, 1, None, 5), row(1, 1, "view", None), row(1, 1, "VIEW", 5), row(1, 1, "error", 5)]
    rows += [row(1, 1, "view", 5, brand="z"), row(1, 1, "view", 5, brand=None), row(1, 1, "view", at(5, 500000)), row(2, 1, "cart", 6, "a", "  ", ""), row(3, 1, "cart", 6, "", " Mixed ", None), row(4, 1, "cart", 6, None), row(5, 1, "cart", 6, "a.b")]
    got = {(r.user_id, r.timestamp, r.brand, r.category, r.user_session) for r in cleanse.clean(frame(spark, rows), S).collect()}
    u = (S.unknown_brand, S.unknown_category, S.unknown_session)
    assert got == {(1, 5, u[0], "a", "s"), (1, 5, "b", "a", "s"), (2, 6, u[0], "a", u[2]), (3, 6, "mixed", u[1], u[2]), (4, 6, "b", u[1], "s"), (5, 6, "b", "a", "s")}
    assert cleanse.clean(frame(spark, rows), S).count() == 6  # two twins below a second apart
    levels = lambda level: {r.user_id: r.category for r in cleanse.clean(frame(spark, rows), Settings(category_level=level)).collect()}
    assert [levels("second")[k] for k in (1, 2, 5)] == ["a.b", "a.general", "a.b"] and levels("full")[1] == "a.b.c"


def small(spark):
    rows = [row(1, 10, "purchase", T1 - 1), row(1, 11, "purchase", T1 - 5, "x.y", "q"), row(2, 10, "purchase", T1 - 9), row(2, 12, "view", T1 - 3), row(1, 12, "cart", T1 - 3)]
    rows += [row(1, 10, "purchase", T1), row(2, 11, "purchase", T1), row(2, 11, "purchase", T2 - 1), row(2, 11, "purchase", T2), row(9, 11, "purchase", T1 + 1), row(9, 99, "purchase", T1 + 2), row(1, 99, "purchase", T1 + 3), row(1, 11, "view", T1 + 3)]
    return Pipeline(frame(spark, rows), S)


def test_split(spark):
    p = small(spark)
    assert {(r.part, r.user_idx, r.item_idx, r.timestamp) for r in p.split.positives.collect()} == {("val", 1, 1, T1), ("test", 1, 1, T2)}
    stats = {r.part: r for r in split.statistics(p.split).collect()}
    assert (stats["val"].n_rows, stats["val"].cold_user_rows, stats["val"].cold_item_rows, stats["val"].repeated_rows, stats["val"].kept_rows, stats["val"].kept_pct) == (6, 2, 1, 1, 2, "33.3%")
    assert [(r.user_idx, r["items"]) for r in split.ground_truth(p.split).where("part = 'val'").collect()] == [(1, [1])]
    wide = Pipeline(p.raw, Settings(train_end=S.train_end, val_end=S.val_end, min_user=1, min_item=1, transductive=True))
    assert wide.split.items.count() == 3
    assert {r.category for r in wide.meta.collect()} == {"a", "x", S.unknown_category}


def test_events_masks_and_checks(spark):
    p = small(spark)
    assert p.events.count() == 3 and edges.auxiliary(p.events, S).count() == 0  # product 12 was never bought
    arrays = {r.user_idx: r["items"] for r in masks.mask_arrays(p.mask("view"), p.users).collect()}
    assert arrays == {1: []}
    with pytest.raises(ValueError):
        p.mask("wish")
    assert {r.violations for r in p.verify().collect()} == {0}
    broken = split.Split(p.split.labelled, p.split.users, p.split.items, p.split.train, p.split.held, p.split.train.withColumn("part", F.lit("test")), p.split.candidates)
    bad = {r.check for r in quality.report(broken, p.events.withColumn("item_idx", F.lit(77).cast("long")), p.meta.limit(1), S).where("violations > 0").collect()}
    assert {"Q1_event_bounds", "Q4_train_eval_leak", "Q5_test_window", "Q11_items_with_metadata"} <= bad


def test_core_is_bounded_and_monotone(spark):
    rows = [row(u, i, "purchase", T1 - 10 * u - i) for u in range(1, 8) for i in range(1, u + 1)] + [row(7, 1, "view", T2 + 5), row(50, 1, "view", 9)]
    log = cleanse.clean(frame(spark, rows), S)
    counts = [core.k_core(log, Settings(train_end=S.train_end, val_end=S.val_end, min_user=k, min_item=k), 9).count() for k in (1, 2, 3, 4, 5)]
    assert counts[0] == log.count() and counts == sorted(counts, reverse=True)
    fixed = core.k_core(log, Settings(train_end=S.train_end, val_end=S.val_end, min_user=3, min_item=3), 9)
    assert core.k_core(fixed, Settings(train_end=S.train_end, val_end=S.val_end, min_user=3, min_item=3), 1).count() == fixed.count()


def test_mode_ties_and_sentinels(spark):
    rows = [row(1, 1, "purchase", 5, "b"), row(1, 1, "view", 6, "a"), row(2, 1, "view", 7, None, ""), row(2, 1, "view", 8, None, ""), row(2, 2, "purchase", 8, "b"), row(3, 2, "view", 8, "a")]
    p = Pipeline(frame(spark, rows), S)
    assert {r.item_idx: r.category for r in p.meta.collect()} == {0: S.unknown_category, 1: "a"}


def test_dense_ids_over_ranges(spark):
    df = spark.createDataFrame([(x,) for x in (5, 900, -3, 5, 2000, None, 1023, 1024)], "k long")
    assert {r.k: r.i for r in dense_ids(df, "k", "i", 4).collect()} == {-3: 0, 5: 1, 900: 2, 1023: 3, 1024: 4, 2000: 5}
    assert {r.k: r.i for r in dense_ids(spark.createDataFrame([("b",), ("a",), ("B",)], "k string"), "k", "i").collect()} == {"B": 0, "a": 1, "b": 2}


def test_ranking_edges(spark):
    users = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "user_idx long, uv array<double>")
    items = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(4)], "item_idx long, iv array<double>")
    mask = spark.createDataFrame([(0, 1)] + [(2, i) for i in range(4)], "user_idx long, item_idx long")
    top = ranking.score_vectors(users, items, mask, 3)
    assert [(r.user_idx, r.item_idx) for r in top.orderBy("user_idx", "rank").collect()] == [(0, 3), (0, 0), (0, 2), (1, 0), (1, 1), (1, 2)]
    truth = spark.createDataFrame([(0, 0), (0, 2), (1, 3), (2, 0)], "user_idx long, item_idx long")
    got = {r.k: (r.hr, r.ndcg) for r in ranking.evaluate(top, truth, (1, 3)).collect()}
    ideal = 1 + 1 / 1.5849625007
    assert got[1] == (0.0, 0.0) and got[3][0] == round(1 / 3, 6) and got[3][1] == round((1 / 1.5849625007 + 0.5) / ideal / 3, 6)
    pop = spark.createDataFrame([(i, 10 - i) for i in range(4)], "item_idx long, n long")
    ranked = ranking.rank_by_popularity(pop, users.select("user_idx"), mask, 2)
    assert {(r.user_idx, r.item_idx, r.rank) for r in ranked.collect()} == {(0, 0, 1), (0, 2, 2), (1, 0, 1), (1, 1, 2)}


def test_best_is_every_product_sorted():
    rng = np.random.default_rng(3)
    for case in range(12):
        x, y, k = rng.normal(size=(rng.integers(1, 400), 5)), rng.normal(size=(rng.integers(1, 3000), 5)), int(rng.integers(1, 40))
        if case % 4 == 1:
            x, y = np.round(x), np.round(y)  # many ties
        if case % 4 == 2:
            y = y[rng.integers(0, max(1, len(y) // 50), len(y))] * 1e-30
        if case % 4 == 3:
            x[0, 0], y[len(y) // 2] = np.inf, np.nan
        row, column = np.sort(rng.integers(0, len(x), 300)), rng.integers(0, len(y), 300)
        with np.errstate(all="ignore"):
            scores = sum(x[:, d, None] * y[None, :, d] for d in range(5)) + 0.0
        scores[row, column] = -np.inf
        first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        kept = np.take_along_axis(scores, first, 1)
        for got, wanted in zip(ranking.best(x, y, row, column, k), (np.nonzero(kept > -np.inf)[0], first[kept > -np.inf], kept[kept > -np.inf]), strict=True):
            assert np.array_equal(got, wanted)


def test_masked_ids_that_repeat_or_are_large(spark):
    big = 2**53 + 1
    users = spark.createDataFrame([(big, [1.0]), (big, [2.0]), (5, [1.0])], "user_idx long, uv array<double>")
    items = spark.createDataFrame([(big, [3.0]), (big, [2.0]), (big - 1, [1.0])], "item_idx long, iv array<double>")
    mask = spark.createDataFrame([(big, big)], "user_idx long, item_idx long")
    got = ranking.score_vectors(users, items, mask, 1)
    assert {(r.user_idx, r.item_idx, r.score) for r in got.collect()} == {(big, big - 1, 2.0), (5, big, 3.0)}


def test_positives_of_a_class_are_not_paired(spark, tmp_path):
    rows = [(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c"), (4, None), (5, "b"), (5, "b"), (None, "a")]
    classes = spark.createDataFrame(rows, "idx long, label string")
    ranked = spark.createDataFrame([(u, i, r + 1) for u in range(6) for r, i in enumerate((5, 4, 3, 2, 1, 0)) if u != i], "user_idx long, item_idx long, rank long")
    truth = spark.createDataFrame([(u, i) for u, a in rows for i, b in rows if None not in (u, i, a) and a == b and u != i], "user_idx long, item_idx long")
    wanted = {tuple(r) for r in ranking.evaluate(ranked, truth, (1, 3, 5)).collect()}
    assert {tuple(r) for r in ranking.evaluate_classes(ranked, classes, (1, 3, 5)).collect()} == wanted
    n = 14_000  # of one label: 196 million pairs
    ids = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(1).write.parquet(f"{tmp_path}/{name}.parquet")
    ids.write.parquet(f"{tmp_path}/embeddings.parquet")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    got = catalog.queries()["hr_ndcg_at_k"](spark, str(tmp_path)).collect()
    late.cancel()
    assert {(r.k, r.hr, r.ndcg) for r in got} == {(k, 1.0, 1.0) for k in catalog.KS}


def test_sampling(spark):
    e = spark.createDataFrame([("view", 0, i % 3, i) for i in range(5)] + [("view", 1, 7, 1)], "rel string, src long, dst long, ts long")
    rows = edges.compressed_rows(e)
    assert {(r.src, r.position, r.degree) for r in rows.collect()} == {(0, i, 5) for i in range(5)} | {(1, 0, 1)}
    few = sampling.without_replacement(rows, 3, "s")
    assert {r.src: r.n for r in few.groupBy("src").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 1}
    assert sampling.with_replacement(rows, 4, "s").count() == 8
    assert edges.compressed_rows(e, dedupe=True).count() == 4
    seen = spark.createDataFrame([(0, i) for i in range(9)], "user_idx long, item_idx long")
    pop = spark.createDataFrame([(i, 1) for i in range(14)], "item_idx long, n long")
    draws = sampling.uniform_negatives(seen.limit(1), seen, pop, 4, 1, "s").collect()
    assert len(draws) == 4 and {r.neg for r in draws} <= {9, 10, 11, 12, 13}  # filled up though the draws are few
    assert {r.neg for r in sampling.uniform_negatives(seen.limit(1), seen, pop.limit(10), 4, 40, "s").collect()} == {9}


def test_minibatches_and_profile(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(103)], "a long, b long")
    got = edges.minibatches(df, S, 10).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in got} == dict.fromkeys(range(10), 10)
    deg = spark.createDataFrame([(0,), (1,), (1,), (4,)], "degree long")
    assert {r.degree: r.p for r in profile.ccdf(deg).collect()} == {1: 1.0, 4: round(1 / 3, 9)}
    assert profile.head_share(deg, [0.25, 0.5]).orderBy("share").collect()[1].events_share == round(5 / 6, 6)
    loss = spark.range(1).select(softplus(F.lit(-50.0)).alias("x"), softplus(F.lit(50.0)).alias("y")).first()
    assert 0 < loss.x < 1e-20 and loss.y == 50.0
    assert objectives.total({"a": (2.0, spark.createDataFrame([(1.5,)], "loss double")), "b": (1.0, spark.createDataFrame([], "loss double"))}).first().loss == 3.0


def test_csv_rows_do_not_depend_on_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text(",".join(RAW) + "\n2024-01-01 00:00:00 UTC,view,1,5,a.b,br,1.5,7,s\nbad time,view,1,5,a,b,1.0,7,s\n2024-01-01 00:00:00 UTC,view,x,5,a,b,1.0,7,s\n2024-01-01 00:00:01 UTC,cart,2,zz,,,,8,\n")
    df = read_raw_csv(spark, str(tmp_path / "*.csv"))
    assert df.count() == df.select("event_type").count() == len(df.collect()) == 2
    assert read_profile_csv(spark, str(tmp_path / "x.csv")).where("event_time IS NOT NULL").count() == 3


def test_command_line_writes_everything(spark, tmp_path):
    lines = [",".join(RAW)] + [f"{at(T1 - 100 + d):%Y-%m-%d %H:%M:%S} UTC,{k},{i},1,a.b,br,2.0,{u},s" for u in range(1, 4) for i in range(1, 4) for d, k in ((u, "purchase"), (i + 200, "purchase"), (5, "view"), (6, "cart")) if (u + i) % 3 or d < 100]
    lines += [f"{at(T1 + 500):%Y-%m-%d %H:%M:%S} UTC,purchase,{i},1,a.b,br,2.0,{u},s" for u in range(1, 4) for i in range(1, 4)]
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    out = tmp_path / "out"
    main(["--input", str(tmp_path / "log.csv"), "--output", str(out), "--train-end", "2024-01-20", "--val-end", "2024-01-25", "--min-user", "1", "--min-item", "1"])
    assert {x.name for x in out.iterdir()} >= {"edges", "train_events", "item_metadata", "mask_primary", "node_counts", "truth", "category_vocab"}
    assert {r.rel for r in spark.read.parquet(str(out / "edges")).select("rel").distinct().collect()} == {"view", "cart", "purchase", "belongsTo", "producedBy", "rev_view", "rev_cart", "rev_purchase", "contains", "brands"}


def test_popularity_rank_has_no_limit_of_items(spark, monkeypatch):
    pop = spark.range(40).select(F.col("id").alias("item_idx"), (F.col("id") * 7 % 5).alias("n"))
    users = spark.createDataFrame([(7,), (8,)], "user_idx long")
    mask = spark.range(38).select(F.lit(7).cast("long").alias("user_idx"), F.col("id").alias("item_idx"))
    plan = ranking.rank_by_popularity(pop, users, mask, 3)._jdf.queryExecution().analyzed().toString()
    assert "GlobalLimit" not in plan
    monkeypatch.setattr(ranking, "SPAN", 4)
    got = [(r.user_idx, r.item_idx, r.rank) for r in ranking.rank_by_popularity(pop, users, mask, 3).orderBy("user_idx", "rank").collect()]
    order = sorted(range(40), key=lambda i: (-(i * 7 % 5), i))
    assert got == [(7, i, k + 1) for k, i in enumerate([i for i in order if i >= 38][:3])] + [(8, i, k + 1) for k, i in enumerate(order[:3])]


def test_mixed_negatives_of_a_user_who_has_seen_the_popular_head(spark):
    pop = spark.range(300).select(F.col("id").alias("item_idx"), (300 - F.col("id")).alias("n"))
    history = spark.range(201).select(F.lit(1).cast("long").alias("user_idx"), F.col("id").alias("item_idx"))
    users = spark.createDataFrame([(1, [1.0])], "user_idx long, uv array<double>")
    items = spark.range(300).select(F.col("id").alias("item_idx"), F.array(F.col("id").cast("double")).alias("iv"))
    positives = spark.createDataFrame([(1, 299)], "user_idx long, item_idx long")
    got = sampling.mixed_negatives(positives, history, pop, users, items, 8, "s").collect()
    assert sorted(r.neg for r in got if r.kind == "hard") == [295, 296, 297, 298]
    assert [len([r for r in got if r.kind == k]) for k in ("popular", "uniform")] == [2, 2]
    assert all(r.neg > 200 and r.neg != 299 for r in got)


def test_popular_draws_follow_the_intervals(spark):
    pop = spark.createDataFrame([(0, 0), (1, 9999), (2, 0), (3, 0)], "item_idx long, n long")
    line = {r.item_idx: (r.low, r.high) for r in sampling.intervals(pop, 0.5).collect()}
    assert line == {0: (0, 1000), 1: (1000, 101000), 2: (101000, 102000), 3: (102000, 103000)}
    positives = spark.createDataFrame([(u, 0) for u in range(200)], "user_idx long, item_idx long")
    got = sampling.popular_negatives(positives, positives.limit(0), pop, 1, 10, 0.5, "s").collect()
    assert len(got) == 200 and sum(r.neg == 1 for r in got) > 180


def test_dense_ids_of_sparse_values(spark):
    values = sorted({(x * 0x9E3779B97F4A7C15) % (1 << 63) - (1 << 62) for x in range(500)})
    got = {r.k: r.i for r in dense_ids(spark.createDataFrame([(v,) for v in values * 2], "k long"), "k", "i", 8).collect()}
    assert got == {v: i for i, v in enumerate(values)}


def test_layer_parts(spark):
    p = layers.LayerParameters(dims=2, freqs=1, rank=1)
    w, a, b, z = p.matrix("W", 2, 2, 0), p.matrix("A", 2, 1, 0), p.matrix("B", 2, 1, 0), p.vector("z", 1, 3)
    assert p.weight(0, 3)[1][0] == w[1][0] + a[1][0] * z[0] * b[0][0]
    vectors = spark.createDataFrame([("user", 0, [1.0, 0.0]), ("product", 0, [0.5, 1.0]), ("product", 1, [2.0, 1.0]), ("brand", 5, [-1.0, 1.0])], "kind string, node long, h array<double>")
    rows = [("user", "view", "product", 0, 0, None, 86400), ("product", "rev_view", "user", 0, 0, None, 86400), ("product", "rev_view", "user", 1, 0, None, 5), ("user", "view", "product", 0, 1, None, 200000)]
    edges_ = spark.createDataFrame(rows, "src_type string, rel string, dst_type string, src long, dst long, origin string, ts long")
    alpha = {(r.rel, r.src, r.dst): r.alpha for r in layers.temporal_attention(edges_, vectors, p, 100000).collect()}
    assert set(alpha) == {("view", 0, 0), ("rev_view", 0, 0), ("rev_view", 1, 0)}  # the later edge is not seen
    assert abs(alpha["rev_view", 0, 0] + alpha["rev_view", 1, 0] - 1) < 1e-9 and abs(alpha["view", 0, 0] - 1) < 1e-9
    found = layers.messages(edges_, vectors, p, 100000)
    out = {(r.kind, r.node): r.h for r in layers.mix_buckets(found, vectors, p).collect()}
    assert out["brand", 5] == [-1.0, 1.0] and out["product", 1] == [2.0, 1.0] and out["user", 0] != [1.0, 0.0]
