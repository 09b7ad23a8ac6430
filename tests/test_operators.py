"""Operators against small brute-force models."""

import random

from pyspark.sql import functions as F

from sluicework.operators import catalog, matching, registry, resolve, telemetry


def test_upsert_and_rerun(spark):
    old = spark.createDataFrame([(1, "a", "keep", 0), (2, "b", None, 0)], "k int, v string, s string, seq int")
    new = spark.createDataFrame([(2, "x", "n", 1), (2, "y", "m", 2), (3, "z", "q", 1)], "k int, v string, s string, seq int")
    first = catalog.upsert(old, new, ["k"], "seq", keep=("s",))
    want = [(1, "a", "keep", 0), (2, "y", "m", 2), (3, "z", "q", 1)]
    assert sorted(map(tuple, first.collect())) == want
    assert sorted(map(tuple, catalog.upsert(first, new, ["k"], "seq", keep=("s",)).collect())) == want


def test_best_by_with_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i}", rng.randrange(50), i) for i in range(600)]
    got = {r.k: (r.v, r.i, r.n_rows) for r in catalog.best_by(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], [F.desc("v"), "i"]).collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        best = min(mine, key=lambda r: (-r[1], r[2]))
        assert got[k] == (best[1], best[2], len(mine))


def test_publish_and_parents(spark):
    rec = spark.createDataFrame([(1, "approved"), (2, "pending"), (3, "approved")], "id int, approval_status string")
    final = rec.filter("id = 1")
    assert sorted(r.id for r in catalog.backfill(final, rec, ["id"]).collect()) == [1, 3]
    kids = spark.createDataFrame([(1, "A "), (2, "b")], "c int, name string")
    parents = spark.createDataFrame([("a", 10, 1), ("a", 11, 2)], "name string, program_id int, t int")
    got = {r.c: (r.parent_id, r.parent_note) for r in catalog.with_parent(kids, parents, ["name"], [F.desc("t")]).collect()}
    assert got == {1: (11, None), 2: (None, "parent not found")}
    assert catalog.replace_partition(rec, rec.filter("id = 2"), "id").count() == 3


def test_telemetry(spark):
    v = spark.createDataFrame([("s", "ok", 2.0, "u"), ("s", "failed", 9.0, "u"), ("t", "ok", 1.0, "w")], "site string, outcome string, seconds double, url string")
    got = {r.site: (r.pages, r.ok, r.mean_seconds, r.status) for r in telemetry.site_report(v).collect()}
    assert got == {"s": (2, 1, 2.0, "partial"), "t": (1, 1, 1.0, "success")}
    assert telemetry.run_totals(telemetry.site_report(v)).first().mean_seconds == 1.5
    assert telemetry.run_totals(telemetry.site_report(v.limit(0))).first().mean_seconds == 0.0
    b = telemetry.budget(spark.range(5).withColumn("k", F.lit(1)), "id", "k", ["id"], 3)
    assert [(r.used, r.allowed) for r in b.orderBy("id").collect()] == [(1, True), (2, True), (3, True), (None, False), (None, False)]
    states = spark.createDataFrame([(0, 0), (0, 3), (2, 0), (2, 1)], "e int, g int").select(telemetry.run_status(F.col("e"), F.col("g")))
    assert [r[0] for r in states.collect()] == ["success", "success", "failed", "partial"]


def test_resolution(spark):
    rows = [
        (1, "d", "Seed Fund", "F", "", "u1", "x", 5, ["a"]),
        (2, "d", "seed fund", "f", "", "u2", None, 9, ["B", "A"]),
        (3, "d", "Eligibility", "", "", "u2", "z", 1, ["c"]),
        (4, "e", "Seed Fund", "F", "", "u3", "w", 5, []),
    ]
    df = spark.createDataFrame(rows, "ord int, domain string, name string, funder string, parent string, url string, amount string, completeness int, tags array<string>")
    c = resolve.clusters(df)
    assert {r.ord: r.cluster for r in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    m = {r.cluster: r for r in resolve.merged(c, ["amount"], ["tags"]).collect()}
    assert (m[1].size, m[1].survivor, m[1].amount, m[1].tags) == (3, 2, "x", ["B", "A", "c"])
    assert m[4].tags is None and resolve.trace(c).count() == 3


def plain_star(rows):
    """Greedy stars over the whole table, without blocks."""
    left, out = [resolve.compared(r) for r in sorted(rows, key=lambda r: r["ord"])], {}
    while left:
        seed = left[0]
        taken = [r for r in left if r is seed or resolve.one_programme(seed, r)]
        out |= {r["ord"]: seed["ord"] for r in taken}
        left = [r for r in left if r["ord"] not in out]
    return out


def test_stars_in_blocks_equal_those_of_the_whole_table(spark, tmp_path):
    rng = random.Random(7)
    names, fields = ["Seed Fund", "Eligibility", "", "Growth Loan", "seed fund"], resolve.FIELDS.split(", ")
    rows = []
    for i in range(150):
        d = f"{rng.choice('abc')}.org"
        url = f"https://{rng.choice([d, d, 'x.org'])}/{rng.choice(['p', 'funding'])}/{rng.choice(['one', 'two', 'three'])}/{rng.choice(['apply', 'overview', 'base', 'info-terms'])}"
        rows.append((i, d, rng.choice(names), rng.choice(["F", "G", ""]), rng.choice(["", "", "M"]), url, [url], rng.choice([[], ["d1"], ["d2", "d3"]]), rng.choice(["", "", "ap"]), rng.choice(["overview", "generic"]), rng.choice(["funding_programme", "news_article"])))
    dicts = [dict(zip([f.split()[0] for f in fields], r, strict=True)) for r in rows]
    keep = lambda df, name: (df.write.mode("overwrite").parquet(path := f"{tmp_path}/{name}-{rng.random()}"), spark.read.parquet(path))[1]
    got = {r.ord: r.cluster for r in resolve.star_clusters(spark.createDataFrame(rows, resolve.FIELDS), keep).collect()}
    assert got == plain_star(dicts) and 1 < len(set(got.values())) < 150


def test_merged_programmes(spark):
    schema = f"cluster long, {resolve.FIELDS}, completeness int, confidence double, nature string, amount double, notes array<string>"
    rows = [
        (1, 1, "a", "Overview", "F", None, "u", ["u"], ["d"], "", "generic", "funding_listing", 5, 0.2, "Direct Funding", None, ["n"]),
        (1, 2, "a", "Seed", "", "P", "v", ["V", "u"], ["D", "e"], "x", "overview", "open_call", 9, 0.3, "Unknown", 4.0, []),
        (1, 3, "b", "Seed two", "G", "", "w", [], [], "y", "eligibility", "funding_programme", 9, 0.3, None, 7.0, ["N", "m"]),
        (4, 4, "c", "Overview", "H", "", "z", ["z"], [], None, "generic", "news_article", 1, 0.1, None, None, []),
    ]
    got = {r.cluster: r for r in resolve.merged_programmes(spark.createDataFrame(rows, schema)).collect()}
    m = got[1]  # order: 2 and 3 by 39, then 1 by 37
    assert (m.size, m.survivor, m.name, m.funder, m.parent, m.apply_url, m.amount, m.domain) == (3, 2, "Seed", "G", "P", "x", 4.0, "a")
    assert (m.page_type, m.role, m.urls, m.documents, m.notes, m.review) == ("funding_programme", "overview", ["V", "u"], ["D", "e"], ["N", "m"], ["merged_multi_page_record"])
    assert (got[4].name, got[4].role, got[4].page_type, got[4].review) == ("Overview", "generic", "news_article", [])


def test_ranked(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("hhhhab"), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    keep = lambda d, name: (d.write.parquet(path := f"{tmp_path}/{rng.random()}"), spark.read.parquet(path))[1]
    want = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert [r.i for r in matching.ranked(df, [F.desc("v"), F.col("i")], keep).orderBy("place").collect()] == [r[2] for r in want]
    per = {(r.k, r.place): r.i for r in matching.ranked_per(df, ["k"], [F.desc("v"), F.col("i")], keep).collect()}
    for k in "hab":
        assert [per[k, n + 1] for n in range(sum(r[0] == k for r in rows))] == [r[2] for r in want if r[0] == k]


def test_preview(spark):
    cols = "sectors array<string>, geography array<string>, funding_type string, ticket_min double, ticket_max double, f_sectors array<string>, f_country string, f_types array<string>, f_min double, f_max double"
    rows = [
        (["Agri-food"], ["Southern Africa"], "Loan", 1.0, 5.0, ["agri"], "x", ["Loan"], 4.0, 9.0),
        (["Agri-food"], ["Europe"], "Loan", 1.0, 5.0, ["agri"], "x", ["Grant"], 4.0, 9.0),
        (["Other"], ["Europe"], "Loan", None, 5.0, ["agri"], "Malawi", ["Loan"], 4.0, 9.0),
        ([], [], "Loan", 1.0, 5.0, None, "Malawi", None, 4.0, 9.0),
        (["Agri"], ["Africa"], "Loan", 1.0, 3.0, ["agri"], "x", [], 4.0, 9.0),
    ]
    got = matching.preview(spark.createDataFrame(rows, cols)).collect()
    assert [(r.preview, r.preview_status) for r in got] == [(100, "high_fit"), (50, "manual_review"), (50, "low_fit"), (15, "manual_review"), (65, "medium_fit")]


def test_best_for_profiles_equals_all_pairs(spark):
    rng = random.Random(5)
    places = ["north", "south", "east"]
    progs = [
        (i, f"n{rng.randrange(9)}", rng.choice([20, 60, 90]), 1, 0, rng.choice([None, 1.0, 5.0]), rng.choice([None, 6.0]), rng.choice([None, 2]), 5, None, None, rng.choice([None, 1]), 9,
         [rng.choice(["agri food", "mining"])], [rng.choice(["tools", "stock"])], [rng.choice(["Startup", "Mature"])], [], rng.choice([[], ["women"]]), rng.choice(["Loan", "Grant"]), rng.choice([[], [rng.choice(places)]]), [], rng.choice(["National", "Province", "Unknown"]))
        for i in range(60)
    ]
    pcols = "pid int, program_name string, view_quality int, view_reasons int, view_blockers int, ticket_min double, ticket_max double, years_min int, years_max int, turnover_min int, turnover_max int, staff_min int, staff_max int, industries array<string>, funds_used array<string>, stages array<string>, raw_eligibility array<string>, ownership_targets array<string>, funding_type string, provinces array<string>, municipalities array<string>, geography_scope string"
    users = [(u, "land", rng.choice([*places, None]), None, rng.choice([["agri"], []]), rng.choice(["idea", "established", None]), rng.choice([["women"], []]), rng.choice([["tools"], []]), rng.choice([["loan"], []]), rng.choice([3, None]), rng.choice([4, None]), rng.choice([2.0, None]), 7.0, None, None) for u in range(25)]
    ucols = "user_id int, country string, province string, municipality string, sectors array<string>, stage string, ownership_targets array<string>, use_of_funds array<string>, preferred_types array<string>, years_operating int, employees int, requested_min double, requested_max double, turnover_min int, turnover_max int"
    p, u = spark.createDataFrame(progs, pcols), spark.createDataFrame(users, ucols)
    got = sorted((r.user_id, r.place, r.pid, r.match, r.importance) for r in matching.best_for_profiles(p, u, 4).collect())
    pairs = matching.prepared_programmes(p).crossJoin(matching.prepared_profiles(u))
    fits = F.concat(F.lit("|"), "p_place", F.lit("|")).contains("|national|") | matching.holds_any(F.col("p_place"), F.filter(F.array(*matching.PLACE), lambda x: F.length(x) > 0))
    good, bad, plus, minus = matching.match_parts(fits)
    total = sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in zip([*good, *bad], [*plus, *minus], strict=True)), F.lit(0))
    pairs = pairs.withColumn("match", F.greatest(F.lit(0), F.least(F.lit(100), total)))
    pairs = pairs.withColumn("importance", matching.importance(F.col("view_quality"), F.col("match")))
    top = matching.top_per(pairs, ["user_id"], matching._best_first(), 4)
    assert got == sorted((r.user_id, r.place, r.pid, r.match, r.importance) for r in top.collect())


def test_shortlists_do_not_depend_on_batches(spark):
    """Best programmes of a kind are the same by one task or many, in small batches, with few rows or limits held; NaN is more than any number."""
    rng = random.Random(8)
    some = lambda *xs: rng.choice([None, *xs])
    progs = [
        (f"k{i:03}", some("a", "b"), rng.choice([20, 60, 90]), i, i % 5, some(1.0, 5.0, float("nan")), some(6.0, float("nan")), some(2), 5, some(1), 9, some(1), 9, rng.choice(["agri", "mine", ""]), "", "", "", "loan", rng.choice(["", "north", "south|national", "east"]))
        for i in range(300)
    ]
    p = spark.createDataFrame(progs, "pid string, program_name string, view_quality int, view_reasons int, view_blockers int, ticket_min double, ticket_max double, years_min int, years_max int, turnover_min int, turnover_max int, staff_min int, staff_max int, p_industry string, p_stage string, p_owned string, p_use string, p_type string, p_place string")
    kinds = spark.createDataFrame([("x", ["agri"], [], [], [], ["loan"], 3, 2, 7, None, 3.0, None), ("y", ["mine", "agri"], [], [], [], [], None, None, None, 4, 2.0, 7.0), ("z", [], [], [], [], [], None, 3, 3, 4, None, None)], "kind string, " + ", ".join(f"{c} array<string>" for c in matching.TEXT_PARTS) + ", f_years int, f_turnover_min int, f_turnover_max int, f_staff int, f_min double, f_max double")
    good, bad, plus, minus = matching.match_parts(F.col("fits"))
    spots = matching._sides(p).select("pid", F.col("p_place").alias("spot"), "sides")
    both = F.when(F.col("sides") == 1, F.array(F.lit(True))).when(F.col("sides") == 2, F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    pairs = p.join(spots, "pid").crossJoin(kinds).withColumn("fits", F.explode(both))
    total = sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in zip([*good, *bad], [*plus, *minus], strict=True)), F.lit(0))
    pairs = pairs.withColumn("match", F.greatest(F.lit(0), F.least(F.lit(100), total))).withColumn("importance", matching.importance(F.col("view_quality"), F.col("match")))
    cut = lambda df: sorted((r.kind, r.spot, r.fits, r.place, r.pid, r.match, r.importance) for r in matching.top_per(df, ["kind", "spot", "fits"], matching._best_first(), 4).collect())
    want = cut(pairs)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for parts, rows, bounds in ((1, "10000", ()), (3, "17", (7, 9))):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert cut(matching.shortlists(p.repartition(parts), kinds, 4, *bounds).withColumnRenamed("p_place", "spot")) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_uploads_are_sent_once_and_summed(spark):
    sent = spark.sparkContext.accumulator(0)

    def send(rows):
        if len(rows) > 2:
            raise TimeoutError
        sent.add(len(rows))
        return {"stored": len(rows), "kinds": [r["k"] for r in rows], "none": [], "half": 0.5, "odd": None}

    rows = spark.range(203).selectExpr("id", "concat('k', id % 3) AS k").coalesce(1)
    got = registry.merged_results(registry.uploaded(rows, send), ["stored", "odd"], ["kinds", "none", "missing"]).collect()
    assert [r.asDict() for r in got] == [{"stored": 203.0, "odd": None, "kinds": ["k0", "k1", "k2"], "none": [], "missing": []}]
    assert sent.value == 203
    empty = registry.merged_results(registry.uploaded(rows.limit(0), send), ["stored"], ["kinds"]).first()
    assert (empty.stored, empty.kinds) == (None, [])


def test_blocks_go_over_nodes_of_equal_keys(spark, tmp_path):
    """Records of equal shared keys are one node; blocks are the components, single records included."""
    rng = random.Random(4)
    row = lambda k, d, n: (k, d, n, "f", "", f"https://{d}/x{k}", [f"https://{d}/x{k}"], [], "", "overview", "funding_programme")
    rows = [row(k, f"d{k % 3}", f"n{k % 3}") for k in range(300)] + [row(900, "e", "alone"), row(901, "g", "alone")]
    df = spark.createDataFrame(rows, resolve.FIELDS)
    keep = lambda d, name: (d.write.parquet(path := f"{tmp_path}/{rng.random()}"), spark.read.parquet(path))[1]
    keys = resolve.block_keys(df).select("ord", F.xxhash64("key").alias("key")).distinct()
    assert resolve.key_nodes(keys, keep)[1].count() == 3
    assert {r.ord: r.block for r in resolve.blocks(df, keep).collect()} == {k: k % 3 for k in range(300)} | {900: 900, 901: 901}
