"""Robust multivariate outliers among document statistics (DataFrame and SQL functions only).

Base statistics come from whole texts. Documents that pass the base rule get the vector

    ln(word_chars / n_words), sqrt(n_symbols / word_chars), sqrt(n_dup_lines / n_lines), sqrt(n_repeat_words / n_words)

rounded to 1/1024. For each language and source a minimum-covariance-determinant estimate is found. The search begins from
several deterministic starts: distances by median and MAD of all dimensions together, the distance along each of the two
halves of the dimensions, and the distance from the origin. From each, concentration steps take the three quarters of the
group's documents that are nearest and estimate mean and covariance from them, until the estimates stay (STEPS at most);
of the starts' last covariances the one with the least determinant holds. It is scaled for consistency at the normal
distribution and has a ridge (FLOORS squared), since most documents have no symbols or repeats at all; the floors are small
enough that each statistic alone can reach the cutoff. A document is kept if its squared Mahalanobis distance is at most
CUTOFF, the 1 - 1e-5 quantile of chi-square with 4 degrees of freedom.

Texts are read once. The search works on distinct vectors with their counts, which are summed where the documents are, so
that a hot source weighs no more there than any other; sums are of integers and quantiles are of integer grades of bounded
range, so results do not depend on the order of rows. Groups of fewer than MIN_GROUP documents are estimated together by
language, and those that still are too few all together.

Defined cases: a null text has no words and fails the base rule; a null language or source is a value of its own;
repeated rows count each; in a pool of fewer than MIN_POOL documents nothing is rejected; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspect.llm.common import heavy_from, join_heavy, n_chars_of, word_list
from twinspect.session import cut, load

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_GROUP, MIN_POOL = 50, 20
STEPS = 8
DIMS = 4
FLOORS = (0.14, 0.05, 0.17, 0.08)
CONSISTENCY = 1.485  # 0.75 / P(chi-square(6) <= the 0.75 quantile of chi-square(4))
CUTOFF = 28.47
GRID = 1024
GRADES, TOP_GRADE = 16, 65535

_LOW = [(a, b) for a in range(DIMS) for b in range(a + 1)]


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text")).withColumn("w", word_list(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "lang", "source", "w", lines.alias("lines"), n_chars_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
    )
    windows = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("h", windows)
    some = F.size("h") > F.size(F.array_distinct("h"))
    rows = rows.withColumn("s", F.when(some, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    twice = F.transform("s", lambda e, i: F.when((e["h"] == F.get("s", i - 1)["h"]) | (e["h"] == F.get("s", i + 1)["h"]), e["p"]))
    rows = rows.withColumn("at", F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    gaps = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW))))
    return rows.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


# Both engines run the expressions below.
BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
VECTOR = [
    f"CAST(round({GRID} * ln(CAST(word_chars AS DOUBLE) / n_words)) AS BIGINT)",
    f"CAST(round({GRID} * sqrt(CAST(n_symbols AS DOUBLE) / word_chars)) AS BIGINT)",
    f"CAST(round({GRID} * sqrt(CAST(n_dup_lines AS DOUBLE) / n_lines)) AS BIGINT)",
    f"CAST(round({GRID} * sqrt(CAST(n_repeat_words AS DOUBLE) / n_words)) AS BIGINT)",
]
XS = [f"x{a}" for a in range(DIMS)]


def own_name(column: str) -> str:
    """A value with its length before it, so that names put together can't be mistaken for others; null is n."""
    return f"CASE WHEN {column} IS NULL THEN 'n' ELSE concat('v', CAST(length({column}) AS STRING), ':', {column}) END"


PAIR_KEY = f"concat({own_name('lang')}, {own_name('source')})"
LANG_KEY = f"concat('lang ', {own_name('lang')})"
GROUP = f"CASE WHEN n_pair >= {MIN_GROUP} THEN pair WHEN n_lang >= {MIN_GROUP} THEN lang_key ELSE 'all' END"
_OFF = [f"power((x{a} - m{a}) / greatest(1.4826 * d{a}, {GRID} * {FLOORS[a]}), 2)" for a in range(DIMS)]
STARTS = [" + ".join(_OFF), f"{_OFF[0]} + {_OFF[1]}", f"{_OFF[2]} + {_OFF[3]}", " + ".join(f"power(x{a} / ({GRID} * {FLOORS[a]}), 2)" for a in range(1, DIMS))]
SUMS = ["CAST(sum(cnt) AS BIGINT) AS n", *(f"CAST(sum(cnt * x{a}) AS BIGINT) AS s{a}" for a in range(DIMS)), *(f"CAST(sum(cnt * x{a} * x{b}) AS BIGINT) AS q{a}{b}" for a, b in _LOW)]
FACTOR = [*(f"mu{a}" for a in range(DIMS)), *(f"l{a}{b}" for a, b in _LOW)]
SPREAD = "round(" + " + ".join(f"ln(l{a}{a})" for a in range(DIMS)) + ", 9)"  # half the logarithm of the determinant


def grade(distance: str) -> str:
    return f"CAST(least({TOP_GRADE}.0, floor({GRADES} * ({distance}))) AS BIGINT)"


def lower_factor() -> list[list[tuple[str, str]]]:
    """Steps of (name, expression) that turn the sums of a group into means and the lower Cholesky factor of its covariance."""
    steps = [[(f"mu{a}", f"CAST(s{a} AS DOUBLE) / n") for a in range(DIMS)]]
    steps.append([
        (f"c{a}{b}", f"{CONSISTENCY} * (CAST(q{a}{b} AS DOUBLE) / n - mu{a} * mu{b})" + (f" + {(GRID * FLOORS[a]) ** 2!r}" if a == b else "")) for a, b in _LOW
    ])
    for b in range(DIMS):
        done = "".join(f" - l{b}{k} * l{b}{k}" for k in range(b))
        steps.append([(f"l{b}{b}", f"sqrt(greatest(c{b}{b}{done}, 1.0))")])
        below = [(f"l{a}{b}", f"(c{a}{b}" + "".join(f" - l{a}{k} * l{b}{k}" for k in range(b)) + f") / l{b}{b}") for a in range(b + 1, DIMS)]
        if below:
            steps.append(below)
    return steps


def whitened() -> list[tuple[str, str]]:
    return [(f"z{a}", f"(x{a} - mu{a}" + "".join(f" - l{a}{k} * z{k}" for k in range(a)) + f") / l{a}{a}") for a in range(DIMS)]


DISTANCE = " + ".join(f"z{a} * z{a}" for a in range(DIMS))


def _with(df: DataFrame, named: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({k: F.expr(e) for k, e in named})


def _distances(rows: DataFrame) -> DataFrame:
    for z in whitened():
        rows = _with(rows, [z])
    return rows.withColumn("distance", F.expr(DISTANCE))


def _factored(sums: DataFrame) -> DataFrame:
    for named in lower_factor():
        sums = _with(sums, named)
    return sums


def mcd_estimates(stats: DataFrame, steps: int = STEPS) -> DataFrame:
    """(pair, n_pair, n, means, factors): the estimate that holds for each language and source. stats: base statistics that pass the base rule."""
    vectors = _with(stats, [("pair", PAIR_KEY), ("lang_key", LANG_KEY), *zip(XS, VECTOR)]).groupBy("pair", "lang_key", *XS).agg(F.count("*").alias("cnt"))
    vectors = cut(vectors)
    pairs = vectors.groupBy("pair", "lang_key").agg(F.sum("cnt").alias("n_pair"), F.count("*").alias("n_vectors"))
    langs = pairs.where(f"n_pair < {MIN_GROUP}").groupBy("lang_key").agg(F.sum("n_pair").alias("n_lang"))
    groups = cut(pairs.join(langs, "lang_key", "left").selectExpr("pair", "n_pair", "n_vectors", f"{GROUP} AS grp"))
    size, heavy = groups.count() * len(STARTS), heavy_from(vectors.count())
    rows = join_heavy(vectors, groups.select("pair", "grp", "n_vectors"), "pair", F.col("n_vectors") >= heavy, XS, size=size)
    rows = cut(rows.groupBy("grp", *XS).agg(F.sum("cnt").alias("cnt")))

    def with_group(rows: DataFrame, table: DataFrame, on: str = "grp") -> DataFrame:
        return join_heavy(rows, table, on, F.col("many") >= heavy, XS, size=size)

    middle = rows.groupBy("grp").agg(F.count("*").alias("many"), *[F.expr(f"percentile(x{a}, 0.5, cnt) AS m{a}") for a in range(DIMS)])
    off = with_group(rows, cut(middle))
    sizes = cut(off.groupBy("grp").agg(*[F.first(c).alias(c) for c in ("many", *(f"m{a}" for a in range(DIMS)))], *[F.expr(f"percentile(abs(x{a} - m{a}), 0.5, cnt) AS d{a}") for a in range(DIMS)]))
    begun = with_group(rows, sizes)
    near = begun.select("grp", *XS, "cnt", F.posexplode(F.array(*[F.expr(grade(x)) for x in STARTS])).alias("start", "grade"))
    sizes, table, last = sizes.select("grp", "many"), None, None
    for _ in range(steps):
        near = cut(near.withColumn("at", F.struct("grp", "start")))
        # Grades are few, so the state of an exact quantile is bounded.
        edges = near.groupBy("at").agg(F.expr("percentile(grade, 0.75, cnt) AS edge")).withColumn("grp", F.col("at.grp")).join(sizes, "grp").select("at", "edge", "many")
        sums = with_group(near, edges, "at").where("grade <= edge").groupBy("grp", "start").agg(*[F.expr(x) for x in SUMS])
        by_start = F.sort_array(F.collect_list(F.struct("start", "n", *FACTOR))).alias("by_start")  # one a start
        table = cut(_factored(sums).groupBy("grp").agg(by_start).join(sizes, "grp"))
        now = table.agg(F.bit_xor(F.xxhash64("grp", "by_start"))).first()[0]
        if now == last:  # no estimate changed
            break
        last = now
        near = _distances(with_group(rows, table).withColumn("f", F.explode("by_start")).select("grp", *XS, "cnt", "f.*"))
        near = near.select("grp", "start", *XS, "cnt", F.expr(grade("distance")).alias("grade"))
    best = table.select("grp", F.explode("by_start").alias("f")).select("grp", "f.*")
    best = best.groupBy("grp").agg(F.min_by(F.struct("n", *FACTOR), F.struct(F.expr(SPREAD), "start")).alias("f")).select("grp", "f.*")
    return groups.select("pair", "n_pair", "grp").join(best, "grp").drop("grp")


def quality(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source): base statistics, base_failed, distance, kept."""
    stats = cut(_with(base_statistics(docs), [("pair", PAIR_KEY), ("base_failed", BASE_FAILED)]))
    table = cut(mcd_estimates(stats.where("NOT base_failed")))
    numbered = stats.withColumn("row_no", F.monotonically_increasing_id())
    rows = join_heavy(numbered, table, "pair", F.col("n_pair") >= heavy_from(stats.count()), ["row_no"], inner=False, size=table.count())
    rows = _distances(_with(rows, [(x, f"CASE WHEN NOT base_failed THEN {v} END") for x, v in zip(XS, VECTOR)]))
    distance = F.when(~F.col("base_failed"), F.when(F.col("n") >= 0.75 * MIN_POOL, F.col("distance")).otherwise(0.0))
    return rows.withColumn("distance", distance).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"), "distance",
    )


def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(load(spark, sf_dir, "documents")).drop("distance")


def _sql() -> str:
    xs = ", ".join(XS)
    gap = "'[\\x20\\x09-\\x0D]+'"
    out = [
        f"t AS (SELECT row_number() OVER () AS row_no, doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), {gap}), lambda x: x <> '') AS w FROM documents)",
        "u AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t)",
        f"g AS (SELECT row_no, p, array_to_string(w[p : p + {WINDOW - 1}], ' ') AS x FROM (SELECT row_no, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM t WHERE len(w) >= {WINDOW}))",
        "d AS (SELECT row_no, p FROM (SELECT row_no, p, count(*) OVER (PARTITION BY row_no, x) AS n FROM g) WHERE n > 1)",
        f"r AS (SELECT row_no, count(DISTINCT p + k)::BIGINT AS n_repeat_words FROM d, range({WINDOW}) AS o(k) GROUP BY row_no)",
        f"stats AS (SELECT u.row_no, doc_id, lang, source, len(w)::BIGINT AS n_words, length(translate(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), ''))::BIGINT AS word_chars, "
        f"(length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM u LEFT JOIN r USING (row_no))",
        f"v AS (SELECT row_no, {', '.join(f'{e} AS {x}' for x, e in zip(XS, VECTOR))}, {PAIR_KEY} AS pair, {LANG_KEY} AS lang_key FROM stats WHERE NOT {BASE_FAILED})",
        "pairs AS (SELECT pair, lang_key, count(*) AS n_pair FROM v GROUP BY ALL)",
        f"langs AS (SELECT lang_key, sum(n_pair) AS n_lang FROM pairs WHERE n_pair < {MIN_GROUP} GROUP BY ALL)",
        f"grps AS (SELECT pair, {GROUP} AS grp FROM pairs LEFT JOIN langs USING (lang_key))",
        f"e AS (SELECT row_no, grp, {xs}, 1 AS cnt FROM v JOIN grps USING (pair))",
        "mid AS (SELECT grp, " + ", ".join(f"quantile_cont({x}, 0.5) AS m{a}" for a, x in enumerate(XS)) + " FROM e GROUP BY grp)",
        "spread AS (SELECT grp, " + ", ".join(f"quantile_cont(abs({x} - m{a}), 0.5) AS d{a}" for a, x in enumerate(XS)) + " FROM e JOIN mid USING (grp) GROUP BY grp)",
        f"near0 AS (SELECT row_no, grp, {xs}, cnt, unnest(range({len(STARTS)})) AS start, unnest([{', '.join(grade(x) for x in STARTS)}]) AS grade FROM e JOIN mid USING (grp) JOIN spread USING (grp))",
    ]

    def distances(rows: str) -> str:
        for c, x in whitened():
            rows = f"(SELECT *, {x} AS {c} FROM {rows})"
        return rows

    for k in range(STEPS):
        out.append(f"edge{k} AS (SELECT grp, start, quantile_cont(grade, 0.75) AS edge FROM near{k} GROUP BY grp, start)")
        out.append(f"f{k}_0 AS (SELECT grp, start, {', '.join(SUMS)} FROM near{k} JOIN edge{k} USING (grp, start) WHERE grade <= edge GROUP BY grp, start)")
        for j, named in enumerate(lower_factor()):
            out.append(f"f{k}_{j + 1} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in named)} FROM f{k}_{j})")
        last = f"f{k}_{len(lower_factor())}"
        if k < STEPS - 1:
            out.append(f"near{k + 1} AS (SELECT row_no, grp, {xs}, cnt, start, {grade(DISTANCE)} AS grade FROM {distances(f'(SELECT e.*, y.* EXCLUDE (grp) FROM e JOIN {last} y USING (grp))')})")
    out.append(f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {SPREAD}, start) AS place FROM {last}) WHERE place = 1)")
    out.append(f"far AS (SELECT row_no, n, {DISTANCE} AS distance FROM {distances('(SELECT e.*, y.* EXCLUDE (grp) FROM e JOIN best y USING (grp))')})")
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
  (NOT {BASE_FAILED} AND coalesce(CASE WHEN n >= {0.75 * MIN_POOL} THEN distance ELSE 0.0 END, 0.0) <= {CUTOFF}) AS kept
FROM stats LEFT JOIN far USING (row_no)"""


SQL = _sql()
