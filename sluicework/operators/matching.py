"""Applicants against programmes: match scores, blended importance, rankings and bounded top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_up, overlap
from ..functions.text import unique_by, words_only
from .quality import labels

# Words of each stage of a business, and reasons and blockers of the match score in order.
STAGE_WORDS = {
    "idea": ("idea", "concept", "startup", "seed", "early stage", "pre-seed"),
    "early": ("early stage", "startup", "seed", "pilot", "trading less than"),
    "growth": ("growth", "scale", "expansion", "established", "series a"),
    "established": ("established", "mature", "scale", "expansion"),
}
MATCH_REASONS = (
    "Strong industry match", "Geography match", "Within funding range", "Business stage match", "Ownership target match", "Use-of-funds match",
    "Years-in-business match", "Turnover range overlaps", "Employee count match", "Preferred funding type",
)
MATCH_BLOCKERS = ("No clear industry match", "Geography may be out of scope", "Requested amount may not fit this programme")
MOST_CLASSES = 4096
"""Kinds of profiles (all but place and user) in one block that is scored against all programmes."""


def normal(items: Column) -> Column:
    """Texts of a list in normal form, blanks left out."""
    some = F.coalesce(items, F.array().cast("array<string>"))
    return F.filter(F.transform(some, words_only), lambda x: F.length(x) > 0)


def joined(*lists: Column) -> Column:
    """All texts of some lists as one, cut by a mark that no normal form has."""
    return F.array_join(normal(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), "|")


def holds_any(haystack: Column, needles: Column) -> Column:
    """Whether any text of ``joined`` lists contains any of ``normal`` needles: no word borders."""
    return F.exists(needles, lambda n: haystack.contains(n))


def prepared_programmes(df: DataFrame) -> DataFrame:
    """Programmes with their texts in normal form, once for all profiles (columns ``p_*``)."""
    return df.select(
        "pid", "program_name", "view_quality", "view_reasons", "view_blockers", "ticket_min", "ticket_max", "years_min", "years_max", "turnover_min", "turnover_max", "staff_min", "staff_max",
        joined("industries", "funds_used", "stages", "raw_eligibility").alias("p_industry"),
        joined("stages").alias("p_stage"), joined("ownership_targets").alias("p_owned"), joined("funds_used").alias("p_use"),
        words_only(F.col("funding_type")).alias("p_type"),
        joined("provinces", "municipalities", F.array("geography_scope")).alias("p_place"),
    )


KIND = ("f_sectors", "f_stage_words", "f_owned", "f_use", "f_types", "f_years", "f_turnover_min", "f_turnover_max", "f_staff", "f_min", "f_max")
PLACE = ("f_country", "f_province", "f_municipality")


def prepared_profiles(df: DataFrame) -> DataFrame:
    """Profiles (``user_id, country, province, municipality, sectors, stage, ...``) with normal forms and a key of their kind."""
    words = F.create_map(*[x for k, v in STAGE_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    stage = F.when(F.length(F.coalesce("stage", F.lit(""))) > 0, F.coalesce(words[F.col("stage")], words["early"]))
    out = df.select(
        "user_id", words_only(F.col("country")).alias("f_country"), words_only(F.col("province")).alias("f_province"), words_only(F.col("municipality")).alias("f_municipality"),
        normal(F.col("sectors")).alias("f_sectors"), normal(stage).alias("f_stage_words"), normal(F.col("ownership_targets")).alias("f_owned"), normal(F.col("use_of_funds")).alias("f_use"),
        normal(F.col("preferred_types")).alias("f_types"), F.col("years_operating").alias("f_years"), F.col("turnover_min").alias("f_turnover_min"), F.col("turnover_max").alias("f_turnover_max"),
        F.col("employees").alias("f_staff"), F.col("requested_min").alias("f_min"), F.col("requested_max").alias("f_max"),
    )
    return out.withColumn("kind", F.sha2(F.to_json(F.struct(*KIND)), 256))


def _inside(x: Column, low: Column, high: Column) -> Column:
    return (x >= low) & (x <= high)


def match_parts(place: Column) -> tuple[list[Column], list[Column], list[int], list[int]]:
    """Conditions and points of the match score, reasons first; ``place`` says whether the geography fits."""
    wants = (F.coalesce("f_min", F.lit(0)) != 0) | (F.coalesce("f_max", F.lit(0)) != 0)
    amount = wants & overlap(F.col("ticket_min"), F.col("ticket_max"), F.col("f_min"), F.col("f_max"))
    industry = holds_any(F.col("p_industry"), F.col("f_sectors"))
    good = [
        industry, place, amount, holds_any(F.col("p_stage"), F.coalesce("f_stage_words", F.array().cast("array<string>"))), holds_any(F.col("p_owned"), F.col("f_owned")),
        holds_any(F.col("p_use"), F.col("f_use")), _inside(F.col("f_years"), F.col("years_min"), F.col("years_max")),
        (F.col("f_turnover_min") <= F.col("turnover_max")) & (F.col("f_turnover_max") >= F.col("turnover_min")), _inside(F.col("f_staff"), F.col("staff_min"), F.col("staff_max")),
        F.array_contains("f_types", F.col("p_type")),
    ]
    no = lambda c: ~F.coalesce(c, F.lit(False))
    bad = [no(industry) & (F.size("f_sectors") > 0), no(place), no(amount) & (F.col("f_min").isNotNull() | F.col("f_max").isNotNull())]
    return good, bad, [28, 20, 18, 10, 10, 10, 6, 6, 6, 8], [-10, -18, -20]


def importance(quality: Column, match: Column) -> Column:
    """Two fifths quality, three fifths match, rounded half up."""
    return half_up(quality * 0.4 + match * 0.6).cast("int")


TEXT_PARTS = ("f_sectors", "f_stage_words", "f_owned", "f_use", "f_types")
"""Answers of a profile that are matched with texts of a programme; the other parts of a kind are numbers."""
MOST_HELD, MOST_LIMITS = 100_000, 4_000_000
"""Rows and limits (one a kind, outcome and place) that a task holds at once; beyond them it gives its rows on and starts anew."""


def _sides(programmes: DataFrame) -> DataFrame:
    """Programmes as ``shortlists`` reads them: ``sides`` has bit 0 if the place may fit, bit 1 if it may not. NaN is more than
    any number, as in Spark's comparisons."""
    national = F.concat(F.lit("|"), "p_place", F.lit("|")).contains("|national|")
    number = lambda c: F.nanvl(c.cast("double"), F.lit(float("inf")))
    numbers = {"ticket_low": F.coalesce("ticket_min", "ticket_max"), "ticket_high": F.coalesce("ticket_max", "ticket_min")} | {c: F.col(c) for c in ("years_min", "years_max", "turnover_min", "turnover_max", "staff_min", "staff_max")}
    return programmes.select(
        "pid", F.coalesce("program_name", F.lit("")).alias("program_name"), *[F.col(c).cast("int").alias(c) for c in ("view_quality", "view_reasons", "view_blockers")],
        F.when(national, "national").otherwise(F.col("p_place")).alias("p_place"), F.when(national, 1).when(F.col("p_place") == "", 2).otherwise(3).alias("sides"),
        "p_industry", "p_stage", "p_owned", "p_use", "p_type", *[number(v).alias(k) for k, v in numbers.items()],
    )


def _kind_rows(kinds: DataFrame) -> list[dict]:
    """A block of kinds, at most about MOST_CLASSES, as rows for the tasks; amounts with one bound are points."""
    number = lambda c: F.nanvl(c.cast("double"), F.lit(float("inf")))
    bounds = {"low": F.coalesce("f_min", "f_max"), "high": F.coalesce("f_max", "f_min")} | {c: F.col(c) for c in ("f_years", "f_turnover_min", "f_turnover_max", "f_staff")}
    wants = (F.coalesce("f_min", F.lit(0)) != 0) | (F.coalesce("f_max", F.lit(0)) != 0)
    return [r.asDict() for r in kinds.select("kind", *TEXT_PARTS, wants.alias("wants"), *[number(v).alias(k) for k, v in bounds.items()]).collect()]


def _conditions(batch: pa.RecordBatch, kinds: list[dict]):
    """Bits of the match (as ``match_parts``, place left out) of a batch's programmes, kind by kind. A word is looked for once
    in a batch, whatever the number of kinds that have it."""
    col = lambda c: batch.column(c)
    nums = {c: col(c).to_numpy(zero_copy_only=False).astype(float) for c in ("ticket_low", "ticket_high", "years_min", "years_max", "turnover_min", "turnover_max", "staff_min", "staff_max")}
    nothing, held, sets = np.zeros(batch.num_rows, dtype=bool), {}, {}

    def has(part: str, word: str) -> np.ndarray:
        if (part, word) not in held:
            found = pc.equal(col(part), word) if part == "p_type" else pc.match_substring(col(part), word)
            held[part, word] = found.to_numpy(zero_copy_only=False)
        return held[part, word]

    def of_texts(kind: dict) -> np.ndarray:
        key = tuple(tuple(kind[c]) for c in TEXT_PARTS)
        if key not in sets:
            industry, stage, owned, use, types = (np.logical_or.reduce([nothing, *(has(part, w) for w in words)]) for part, words in zip(("p_industry", "p_stage", "p_owned", "p_use", "p_type"), key, strict=True))
            sets[key] = industry | stage << 2 | owned << 3 | use << 4 | types << 8 | (~industry if key[0] else nothing) << 9
        return sets[key]

    def inside(x, low, high) -> np.ndarray:
        return nothing if x is None else (nums[low] <= x) & (nums[high] >= x)

    def met(low: float | None, high: float | None, least: str, most: str) -> np.ndarray:
        return nothing if low is None or high is None else (nums[least] <= high) & (nums[most] >= low)

    for kind in kinds:
        asked = kind["low"] is not None
        amount = met(kind["low"], kind["high"], "ticket_low", "ticket_high") if kind["wants"] else nothing
        years, staff = inside(kind["f_years"], "years_min", "years_max"), inside(kind["f_staff"], "staff_min", "staff_max")
        turnover = met(kind["f_turnover_min"], kind["f_turnover_max"], "turnover_min", "turnover_max")
        yield of_texts(kind) | amount << 1 | years << 5 | turnover << 6 | staff << 7 | (~amount if asked else nothing) << 10


def shortlists(programmes: DataFrame, kinds: DataFrame, k: int, most_held: int = MOST_HELD, most_limits: int = MOST_LIMITS) -> DataFrame:
    """Of each task's programmes the best k for each kind of profile, place and outcome (``fits``: the place does or doesn't).

    Programmes of each batch are scored for all kinds of the block at once, as columns, and only those that reach the k-th best so
    far are looked at more closely; no row is made for the others. Of National programmes only the fit is kept, of placeless
    ones only the misfit."""
    sides = _sides(programmes)
    shared = sides.sparkSession.sparkContext.broadcast(_kind_rows(kinds))
    _, _, plus, minus = match_parts(F.lit(False))
    weights = [*[p for i, p in enumerate(plus) if i != 1], minus[0], minus[2]]
    of_place = {True: plus[1], False: minus[1]}
    pid = dict(sides.dtypes)["pid"]
    shape = f"kind string, p_place string, fits boolean, pid {pid}, program_name string, view_quality int, view_reasons int, view_blockers int, bits int, match int, importance int"
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches):
        kinds = shared.value
        points = np.array([sum(w for i, w in enumerate(weights) if b >> i & 1) for b in range(1 << len(weights))])
        places: dict[str, int] = {}
        limits: dict[tuple, np.ndarray] = {}
        held: dict[tuple, list] = {}
        n_held = 0

        def given(types):
            rows = [(kinds[t]["kind"], p, fits, r[2], r[1], *r[3:]) for (t, fits, p), best in held.items() for r in best]
            return pa.RecordBatch.from_arrays([pa.array(x, type=types[n]) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for batch in batches:
            int_, text = pa.int32(), pa.string()
            types = dict(zip(names, [text, text, pa.bool_(), batch.column("pid").type, text, *[int_] * 6], strict=True))
            if 2 * len(kinds) * len(places) > most_limits:
                places, limits = {}, {}
            listed = pc.dictionary_encode(batch.column("p_place"))
            known = np.array([places.setdefault(p, len(places)) for p in listed.dictionary.to_pylist()], dtype=np.int64)
            here = known[listed.indices.to_numpy(zero_copy_only=False)] if batch.num_rows else known
            spots = list(places)
            quality, outcome = batch.column("view_quality").to_numpy(zero_copy_only=False), batch.column("sides").to_numpy(zero_copy_only=False)
            shown = {c: batch.column(c) for c in ("program_name", "pid", "view_reasons", "view_blockers")}
            order = pc.sort_indices(pa.table([shown["program_name"], shown["pid"]], names=["n", "p"]), sort_keys=[("n", "ascending"), ("p", "ascending")]).to_numpy()
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            for t, bits in enumerate(_conditions(batch, kinds)):
                base = points[bits]
                for fits, more in of_place.items():
                    match = np.clip(base + more, 0, 100)
                    blended = np.floor(quality * 0.4 + match * 0.6 + 0.5).astype(np.int64)
                    worth = (blended * 1000 + quality) * 1000 + match
                    limit = limits.get((t, fits), np.zeros(0, dtype=np.int64))
                    if len(limit) < len(places):
                        limit = limits[t, fits] = np.concatenate([limit, np.full(len(places) - len(limit), -1)])
                    some = np.nonzero((outcome & (1 if fits else 2) != 0) & (worth >= limit[here]))[0]
                    if not len(some):
                        continue
                    some = some[np.lexsort((rank[some], -worth[some], here[some]))]
                    first = np.r_[True, np.diff(here[some]) != 0]
                    starts = np.nonzero(first)[0]
                    some = some[np.arange(len(some)) - starts[np.cumsum(first) - 1] < k]
                    touched = set()
                    for i in some.tolist():
                        row = (-int(worth[i]), *(shown[c][i].as_py() for c in ("program_name", "pid")), int(quality[i]), *(shown[c][i].as_py() for c in ("view_reasons", "view_blockers")), int(bits[i]), int(match[i]), int(blended[i]))
                        held.setdefault((t, fits, spots[here[i]]), []).append(row)
                        touched.add(here[i])
                    n_held += len(some)
                    for place in touched:
                        mine = held[t, fits, spots[place]]
                        mine.sort(key=lambda r: r[:3])
                        n_held -= len(mine[k:])
                        del mine[k:]
                        if len(mine) == k:
                            limit[place] = max(limit[place], -mine[-1][0])
                if n_held > most_held:
                    yield given(types)
                    held, n_held = {}, 0
        if held:
            yield given(types)

    return sides.mapInArrow(run, shape)


def reason_tags(bits: Column, fits: Column, match: Column, quality: Column, view_reasons: Column, view_blockers: Column) -> Column:
    """First six tags: why it matches, why it is good, and below half of either score what speaks against it."""
    none = F.array().cast("array<string>")
    rest = [n for i, n in enumerate(MATCH_REASONS) if i != 1]
    first = labels(bits, tuple(rest[:1]))
    place = F.when(fits, F.array(F.lit(MATCH_REASONS[1]))).otherwise(none)
    others = labels(F.shiftright(bits, 1), tuple(rest[1:]))
    against = F.concat(
        labels(F.shiftright(bits, 9), MATCH_BLOCKERS[:1]), F.when(~fits, F.array(F.lit(MATCH_BLOCKERS[1]))).otherwise(none), labels(F.shiftright(bits, 10), MATCH_BLOCKERS[2:])
    )
    from .quality import VIEW_BLOCKERS, VIEW_REASONS

    tags = F.concat(first, place, others, labels(view_reasons, VIEW_REASONS), F.when(match < 50, against).otherwise(none), F.when(quality < 50, labels(view_blockers, VIEW_BLOCKERS)).otherwise(none))
    return F.slice(unique_by(tags, words_only), 1, 6)


ORDER = ("importance", "view_quality", "match", "program_name", "pid")


def _best_first() -> list[Column]:
    return [F.desc("importance"), F.desc("view_quality"), F.desc("match"), F.coalesce("program_name", F.lit("")), F.col("pid")]


def place_fits() -> Column:
    """Whether a programme's place (``national`` for all of them) is the profile's country, province or municipality."""
    wanted = F.filter(F.array(*PLACE), lambda x: F.length(x) > 0)
    return (F.col("p_place") == "national") | ((F.col("p_place") != "") & holds_any(F.col("p_place"), wanted))


def _kind_blocks(profiles: DataFrame) -> list[DataFrame]:
    """Distinct kinds of profiles in blocks of about MOST_CLASSES."""
    kinds = profiles.select("kind", *KIND).dropDuplicates(["kind"])
    blocks = -(-kinds.count() // MOST_CLASSES)
    return [kinds] if blocks < 2 else [kinds.filter(F.pmod(F.xxhash64("kind"), F.lit(blocks)) == b) for b in range(blocks)]


def best_for_profiles(programmes: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """The k programmes of most importance for every profile, of all programmes.

    The score depends on the profile's kind and on whether the place fits. So the best k of each kind, programme place and
    outcome hold the best k of every profile; each task cuts its rows down to them before the shuffle. Profiles then join
    those short lists by kind and place."""
    programmes, profiles = prepared_programmes(programmes), prepared_profiles(profiles)
    per_place = Window.partitionBy("kind", "p_place", "fits").orderBy(*_best_first())
    lists = None
    for block in _kind_blocks(profiles):
        short = shortlists(programmes, block, k)
        lists = short if lists is None else lists.unionByName(short)
    lists = lists.withColumn("n", F.row_number().over(per_place)).filter(F.col("n") <= k).drop("n")
    spots = profiles.select("kind", *PLACE).distinct()
    per_spot = Window.partitionBy("kind", *PLACE).orderBy(*_best_first())
    met = spots.join(lists, "kind").filter(F.col("fits") == place_fits())
    top = met.withColumn("place", F.row_number().over(per_spot)).filter(F.col("place") <= k)
    tags = reason_tags(F.col("bits"), F.col("fits"), F.col("match"), F.col("view_quality"), F.col("view_reasons"), F.col("view_blockers"))
    return profiles.select("user_id", "kind", *PLACE).join(top.withColumn("tags", tags), ["kind", *PLACE]).select("user_id", "place", "pid", "match", "importance", "tags")


PREVIEW_PLACES = ("africa", "malawi")
"""Fixed values: words of a region or country that the preview takes for eligible."""


def preview(pairs: DataFrame) -> DataFrame:
    """Adds ``preview`` and ``preview_status``: 35 sector, 30 geography, 20 funding type, 15 amount with all four bounds.

    Needs ``sectors, geography, funding_type, ticket_min, ticket_max`` and ``f_sectors, f_country, f_types, f_min, f_max``.
    A programme without regions fits nowhere; another fits if a region of it or the country has a word of the list."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<string>")
    sector = F.exists(F.coalesce("f_sectors", none), lambda s: F.exists(F.coalesce("sectors", none), lambda p: low(p).contains(low(s))))
    word = lambda c: low(c).rlike("|".join(PREVIEW_PLACES))
    place = F.exists(F.coalesce("geography", none), lambda r: word(r) | word(F.col("f_country")))
    kind = F.array_contains(F.coalesce("f_types", none), F.col("funding_type"))
    amount = (F.col("ticket_max") >= F.col("f_min")) & (F.col("ticket_min") <= F.col("f_max"))
    pick = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    total = pick(sector, 35) + pick(place, 30) + pick(kind, 20) + pick(amount, 15)
    blocked = ~F.coalesce(place, F.lit(False))
    state = F.when(total >= 80, "high_fit").when(total >= 60, "medium_fit").when(blocked, "manual_review").otherwise("low_fit")
    return pairs.withColumns({"preview": total, "preview_status": state})


def top_per(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key with ``place`` from 1; cut down before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)


def top_overall(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows with ``place``: every task keeps k, and only k rows are numbered."""
    return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def ranked(df: DataFrame, order: list, keep, place: str = "place") -> DataFrame:
    """All rows with their place in an order: sorted by ranges over the cluster, numbered within each range, and moved on
    by the rows of the ranges before (one number a range). ``keep`` writes a frame and reads it back."""
    at = F.monotonically_increasing_id()
    sorted_ = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    sizes = dict(sorted_.groupBy("_range").count().collect())
    before, starts = 0, []
    for r in sorted(sizes):
        starts.append((r, before))
        before += sizes[r]
    moved = df.sparkSession.createDataFrame(starts, "_range long, _start long")
    return sorted_.join(F.broadcast(moved), "_range").withColumn(place, F.col("_start") + F.col("_at") + 1).drop("_range", "_at", "_start")


def ranked_per(df: DataFrame, keys: list[str], order: list, keep) -> DataFrame:
    """All rows with their ``place`` within their key, however many rows a key has."""
    whole = ranked(df, [*[F.col(k) for k in keys], *order], keep, "_place")
    first = whole.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return whole.join(first, keys).withColumn("place", F.col("_place") - F.col("_first") + 1).drop("_place", "_first")
