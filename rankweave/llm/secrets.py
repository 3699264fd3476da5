"""Secret scan with multipart credential linking, native expressions only.

Every pattern's matches become rows ``(document, kind, start, end)``. Positions come from the pieces between matches: the
start of a match is the running sum of the lengths of the pieces and matches before it. Strong (base) matches always
count. Weak candidates - identifiers, short or unlabelled secrets, endpoints - are joined by interval: two parts belong together
if at most ``SCOPE`` code points lie between the end of one and the start of the other (overlapping parts do). Each span asks from
the place ``SCOPE`` behind its end how far the parts that start up to there reach at most; if that is not further back than
``SCOPE`` before its own start, one of them is in scope. Spans and questions are ordered together, so a document's spans are
passed over once and never paired with each other. A weak candidate is reported only if its complement lies in its scope:

* a weak identifier needs a secret (strong or weak),
* a weak secret needs an identifier (strong or weak),
* an endpoint needs both.

A weak candidate that overlaps a base span is dropped: the base span says the same.

What counts as weak: an identifier is a run of 12 or more capitals and digits with both among them and not within a secret, or what is assigned to a
label such as client_id or username; a secret is a run of 40 or more letters, digits, plus signs and slashes with small and
capital letters and digits among them, or an assignment whose value has 3 to 5 characters; an endpoint is a URL with a scheme of 2
to 16 characters, four numbers with dots, or what is assigned to a label such as host or endpoint. Labels match in either
case, with up to 8 blanks on each side of the sign of assignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_of

#: Most code points between parts that belong together.
SCOPE = 200

_KEY = r"(password|passwd|secret|token|api_?key)"
_SEP = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"(?i:{_KEY}){_SEP}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 characters or more
_LABELLED = r"""["']?\x20{0,8}[:=]\x20{0,8}["']?"""
WEAK_ACCESS = r"[A-Z0-9]{12,}"  # with a letter and a digit
WEAK_ID = rf"(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login){_LABELLED}([A-Za-z0-9.@_+-]+)"
WEAK_SECRET = r"[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = rf"""[a-z][a-z0-9+.-]{{1,15}}://[^\x20\x09-\x0D"'<>]+|[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}|(?i:hostname|host|endpoint|server){_LABELLED}[A-Za-z0-9.:/_-]+"""

#: kind, order within a start, pattern, part of a credential, strong
KINDS = (
    ("assign", 0, ASSIGN, "secret", True),
    ("access", 1, ACCESS, "access", True),
    ("hex", 2, HEX, "secret", True),
    ("weak_access", 3, WEAK_ACCESS, "access", False),
    ("weak_secret", 4, WEAK_SECRET, "secret", False),
    ("endpoint", 5, ENDPOINT, "endpoint", False),
    ("weak_id", 6, WEAK_ID, "access", False),
)
EMPTY = "array<struct<no:int,i:int,gap:int,len:int,ok:int>>"


def _matches(text: Column, no: int, kind: str, pattern: str) -> Column:
    """A struct per match: kind, place in order, length of the piece before it, own length, and what it counts as
    (2 strong or full, 1 weak, 0 nothing)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    if kind == "assign":
        value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x))
        ok = F.transform(value, lambda n: F.when(n >= 6, 2).when(n >= 3, 1).otherwise(0))
    elif kind == "weak_access":
        ok = F.transform(found, lambda x: (x.rlike("[A-Z]") & x.rlike("[0-9]")).cast("int"))
    elif kind == "weak_secret":
        ok = F.transform(found, lambda x: (x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]")).cast("int"))
    else:
        ok = F.transform(found, lambda _: F.lit(2 if no < 3 else 1))
    lens = F.transform(found, lambda x: F.length(x))
    items = F.transform(
        F.arrays_zip(lens.alias("len"), gaps.alias("gap"), ok.alias("ok")),
        lambda x, i: F.struct(F.lit(no).alias("no"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok")),
    )
    return F.when(text.rlike(pattern), F.filter(items, lambda x: x["len"].isNotNull())).otherwise(F.lit(None).cast(EMPTY))


def linked_spans(docs: DataFrame) -> DataFrame:
    """A row per span, and for a document without any, at least one row with a null kind: doc_id, tag, no, start, end, base.

    ``tag`` tells repeated rows apart. Null text counts as empty. Further columns are ignored.
    """
    text = text_of()
    none = F.array().cast(EMPTY)
    parts = [F.coalesce(_matches(text, no, kind, p), none) for kind, no, p, _, _ in KINDS]
    rows = (
        docs.select("doc_id", F.monotonically_increasing_id().alias("tag"), F.concat(*parts).alias("m"))
        .select("doc_id", "tag", F.explode_outer("m").alias("m"))
        .select("doc_id", "tag", "m.*")
        .repartition("tag")  # both windows and the sums below stay on this one exchange
    )
    running = Window.partitionBy("tag", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(running)).withColumn("start", F.col("end") - F.col("len"))
    # a match that counts as nothing is no span, but may be all that its document has
    rows = rows.withColumn("no", F.when(F.col("ok") > 0, F.col("no"))).withColumn("base", F.coalesce((F.col("no") < 3) & (F.col("ok") == 2), F.lit(False)))
    # an assignment too short to be strong is a weak secret
    rows = rows.withColumn("no", F.when((F.col("no") == 0) & ~F.col("base"), 4).otherwise(F.col("no")))
    part = {p: F.lit(False) for p in ("access", "secret", "endpoint")}
    for _, no, _, p, _ in KINDS:
        part[p] = part[p] | (F.col("no") == no)
    # capitals and digits inside a secret are part of it, not an identifier
    ahead = Window.partitionBy("tag").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    inside = F.max(F.when(part["secret"], F.col("end"))).over(ahead) > F.col("start")
    rows = rows.withColumn("inside", inside).withColumn("no", F.when(~((F.col("no") == 3) & F.coalesce("inside", F.lit(False))), F.col("no"))).drop("inside")
    # a question follows the spans that start at its place
    asked = rows.withColumn("q", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("place", F.when(F.col("q") == 1, F.col("end") + SCOPE).otherwise(F.col("start")))
    sofar = Window.partitionBy("tag").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    reach = lambda p: F.max(F.when((F.col("q") == 0) & part[p], F.col("end"))).over(sofar)
    behind = Window.partitionBy("tag").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    rows = (
        asked.withColumn("has_access", (reach("access") >= F.col("start") - SCOPE).cast("int"))
        .withColumn("has_secret", (reach("secret") >= F.col("start") - SCOPE).cast("int"))
        .where("q = 1")
        .withColumn("base_end", F.max(F.when(F.col("base"), F.col("end"))).over(ahead))
        .withColumn("base_start", F.min(F.when(F.col("base"), F.col("start"))).over(behind))
    )
    free = (F.coalesce(F.col("base_end"), F.lit(-1)) <= F.col("start")) & (F.col("base_start").isNull() | (F.col("base_start") >= F.col("end")))
    linked = (
        F.when(F.col("no").isin(3, 6), F.col("has_secret") == 1)
        .when(F.col("no") == 4, F.col("has_access") == 1)
        .when(F.col("no") == 5, (F.col("has_access") == 1) & (F.col("has_secret") == 1))
        .otherwise(False)
    )
    return rows.withColumn("report", F.col("base") | F.coalesce(linked & free, F.lit(False))).select("doc_id", "tag", "no", "start", "end", "base", "report")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_weak, base_sha256, spans: one row per input row.

    Defined results: no spans give zeros, an empty list and the digest of the empty string; repeated rows are scanned
    each for itself; an empty table gives an empty result.
    """
    name = F.element_at(F.array(*[F.lit(k) for k, *_ in KINDS]), F.col("no") + 1)
    span = F.struct("start", "no", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    base = F.when(F.col("base"), span)
    every = F.when(F.col("report"), span)
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["s"]), ",")
    count = lambda no: F.count(F.when(F.col("base") & (F.col("no") == no), 1))
    return (
        linked_spans(docs)
        .groupBy("tag")
        .agg(
            F.first("doc_id").alias("doc_id"),
            count(0).alias("n_assign"),
            count(1).alias("n_access"),
            count(2).alias("n_hex"),
            F.count(F.when(F.col("report") & ~F.col("base"), 1)).alias("n_weak"),
            joined(base).alias("base_spans"),
            joined(every).alias("spans"),
        )
        .select("doc_id", "n_assign", "n_access", "n_hex", "n_weak", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
    )


def op2_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def _sql_kind(kind: str, no: int, pattern: str) -> str:
    p = pattern.replace("'", "''")
    value = f"regexp_extract_all(t, '{p}', 2)" if kind == "assign" else f"regexp_extract_all(t, '{p}')"
    ok = {
        "assign": "CASE WHEN length(v) >= 6 THEN 2 WHEN length(v) >= 3 THEN 1 ELSE 0 END",
        "weak_access": "CASE WHEN regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') THEN 1 ELSE 0 END",
        "weak_secret": "CASE WHEN regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') THEN 1 ELSE 0 END",
    }.get(kind, str(2 if no < 3 else 1))
    return f"""
  SELECT doc_id, {no} AS no, i, gap, len, {ok} AS ok FROM (
    SELECT doc_id, unnest(range(len(f))) AS i, unnest(list_transform(f, lambda x: length(x))) AS len, unnest(v) AS v,
           unnest(list_transform(g[1:len(f)], lambda x: length(x))) AS gap
    FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS f, {value} AS v, string_split_regex(t, '{p}') AS g
          FROM d WHERE regexp_matches(t, '{p}')))"""


SQL_OP2 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ("
    + " UNION ALL ".join(_sql_kind(k, no, p) for k, no, p, _, _ in KINDS)
    + f"""
), p AS (
  SELECT *, sum(gap + len) OVER (PARTITION BY doc_id, no ORDER BY i)::BIGINT AS "end" FROM m
), b AS (
  SELECT doc_id, CASE WHEN no = 0 AND ok = 1 THEN 4 ELSE no END AS no, "end" - len AS start, "end", no < 3 AND ok = 2 AS base FROM p WHERE ok > 0
), o AS (
  SELECT *, coalesce(max(CASE WHEN no IN (0, 2, 4) THEN "end" END) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > start, false) AS inside FROM b
), y AS (
  SELECT *, CASE WHEN q = 1 THEN "end" + {SCOPE} ELSE start END AS place FROM o CROSS JOIN (VALUES (0), (1)) AS v(q) WHERE no <> 3 OR NOT inside
), z AS (
  SELECT *, max(CASE WHEN q = 0 AND no IN (1, 3, 6) THEN "end" END) OVER sofar AS access_end, max(CASE WHEN q = 0 AND no IN (0, 2, 4) THEN "end" END) OVER sofar AS secret_end
  FROM y WINDOW sofar AS (PARTITION BY doc_id ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), w AS (
  SELECT *, coalesce(access_end >= start - {SCOPE}, false)::INT AS has_access, coalesce(secret_end >= start - {SCOPE}, false)::INT AS has_secret,
         max(CASE WHEN base THEN "end" END) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base_end,
         min(CASE WHEN base THEN start END) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS base_start
  FROM z WHERE q = 1
), r AS (
  SELECT *, base OR (coalesce(base_end, -1) <= start AND (base_start IS NULL OR base_start >= "end") AND
         CASE no WHEN 3 THEN has_secret = 1 WHEN 6 THEN has_secret = 1 WHEN 4 THEN has_access = 1 WHEN 5 THEN has_access = 1 AND has_secret = 1 ELSE false END) AS report,
         [{', '.join(f"'{k}'" for k, *_ in KINDS)}][no + 1] || ':' || start || ':' || "end" AS s
  FROM w
), a AS (
  SELECT doc_id, count(*) FILTER (base AND no = 0) AS n_assign, count(*) FILTER (base AND no = 1) AS n_access,
         count(*) FILTER (base AND no = 2) AS n_hex, count(*) FILTER (report AND NOT base) AS n_weak,
         string_agg(s, ',' ORDER BY start, no) FILTER (base) AS bs, string_agg(s, ',' ORDER BY start, no) FILTER (report) AS spans
  FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_weak, 0) AS n_weak, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id IS NOT DISTINCT FROM a.doc_id
"""
)
