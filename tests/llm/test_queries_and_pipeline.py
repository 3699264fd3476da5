"""The registered queries against their SQL, and the pipeline against its stages done plainly."""

import collections
import itertools
import os
import random
import re

import duckdb
import pytest

import corpus_pipeline
from rankweave.llm import exact_dedup, mixing, nbsvm, packing, queries
from rankweave.llm.common import documents, labels

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df, rel = queries.queries()[name](spark, D), duck.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    tidy = lambda row: tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in row)
    at = [list(rel.columns).index(c) for c in cols]
    key = lambda row: tuple(map(str, row))
    assert sorted((tidy(r) for r in df.select(*cols).collect()), key=key) == sorted((tidy([r[i] for i in at]) for r in rel.fetchall()), key=key)


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries() if q.startswith("op")) == list(range(1, 11))


def test_native_queries_use_no_python(spark, monkeypatch):
    from rankweave.llm import common, mixing, secrets

    plans = []
    whole = common.materialize

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, name)

    for module in (exact_dedup, mixing):
        monkeypatch.setattr(module, "materialize", watched)
    for name in ("op2_secret_linking", "op6_exact_dedup", "op9_pareto_mixing"):
        plans.append(queries.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and secrets  # what is written on the way counts too
    for plan in plans:
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- the pipeline on repeated rows, null ids and clashing names, against plain Python


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = re.compile(r"[\x20\x09-\x0D]")


def awkward_documents(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(36):
        words = [word() for _ in range(r.choice([60, 90, 200]))]
        text = " ".join(words)
        i = None if k % 9 == 0 else k
        rows.append((i, text))
        if k % 4 == 0:  # the same row again, twice
            rows += [(i, text)] * 2
        if k % 6 == 1:  # an exact copy but for white space, longer
            rows.append((100 + k, text.replace(" ", "  ")))
        if k % 6 == 2:  # a near copy
            words[len(words) // 2] = "changed"
            rows.append((200 + k, " ".join(words)))
    rows += [(None, ""), (None, None), (300, ""), (301, "bad*** &&& *** junk### " * 20), (302, "bad*** &&& *** junk### " * 20)]
    out = [(i, t, "en", None if n % 7 == 0 else f"src{n % 3}", len(t or ""), n, "x", "y", "z", "w") for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, nth long, _keep string, _source string, _sid string, `a.b` string")
    return df, out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_keep_whole_rows_of_awkward_documents(spark):
    df, rows = awkward_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    # quality: rows that the scores accept, as often as they are there
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 30)] + [(301, 0, 0), (302, 0, 0)], "doc_id long, quality int, toxic int")
    good = nbsvm.keep_good(df, labels)
    assert good.columns == df.columns
    accepted = collections.Counter((r.doc_id, r.predicted) for r in nbsvm.quality_scores(df, labels).collect())
    assert collections.Counter(r[0] for r in rows_of(good)) == collections.Counter({i: n for (i, p), n in accepted.items() if p})
    # exact copies: longest, then smallest id, nulls last; one row of each group
    best = {}
    for n, row in enumerate(rows):
        key = BLANKS.sub("", row[1] or "")
        order = (-len(row[1] or ""), row[0] is None, row[0] or 0)
        if key not in best or order < best[key][0]:
            best[key] = (order, {(row[0], row[1])})
        elif order == best[key][0]:
            best[key][1].add((row[0], row[1]))
    once = stages["exact_dedup"](spark, df, "")
    got = rows_of(once)
    assert once.columns == df.columns and set(got) <= {tuple(r) for r in rows} and len(got) == len(best)
    assert all((r[0], r[1]) in best[BLANKS.sub("", r[1] or "")][1] for r in got)
    # near copies: 5-word sets, one row of each component; on the rows with all their repeats
    runs = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]) for w in (WORDS.findall((r[1] or "").lower()) for r in rows)]
    comp = list(range(len(rows)))
    for _ in range(3):
        for i, j in itertools.combinations(range(len(rows)), 2):
            if 5 * len(runs[i] & runs[j]) >= 4 * len(runs[i] | runs[j]):
                comp[i] = comp[j] = min(comp[i], comp[j])
    groups = collections.defaultdict(list)
    for c, r in zip(comp, rows):
        groups[c].append(r)
    one = rows_of(stages["near_dedup"](spark, df, ""))
    assert len(one) == len(groups) and set(one) <= {tuple(r) for r in rows}
    least = sorted(repr(min((r[0] is None, r[0] or 0) for r in g)) for g in groups.values())
    assert sorted(repr((r[0] is None, r[0] or 0)) for r in one) == least
    # mixing: every row as often as its copies say, rows with one id each for itself
    mixed = stages["mixing"](spark, df, "")
    assert mixed.columns == df.columns
    plan = collections.Counter()
    for r in mixing.sampled(df, df.columns).collect():
        plan[tuple(r.row)] += r.copies
    assert collections.Counter(tuple(r) for r in mixed.collect()) == +plan and max(plan.values()) <= 2
    words = lambda some: sum(len(WORDS.findall(r[1] or "")) * n for r, n in some)
    assert words(plan.items()) == pytest.approx(1.5 * words((tuple(r), 1) for r in rows), rel=0.15)
    # packing: every row's pieces, each for itself
    tok = packing.encoder(packing.public_tokenizers.path(packing.TOKENIZER)).tokenizer
    want = collections.Counter()
    for r in rows:
        n = len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1
        a, b, k = 0, (n - 1) % 2048 + 1, 0
        while a < n:
            want[(r[0], k, a, b - a)] += 1
            a, b, k = b, b + 2048, k + 1
    packed = stages["packing"](spark, df, "").collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in packed) == want
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, df.limit(0), "").count() == 0, name


def test_pipeline_stages(spark):
    docs = documents(spark, D)
    good = nbsvm.keep_good(docs, labels(spark, D))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in nbsvm.quality_scores(docs, labels(spark, D)).where("predicted = 1").collect()}
    once = exact_dedup.keep_first(good)
    kept = {r.doc_id for r in once.collect()}
    assert kept == {r.doc_id for r in exact_dedup.exact_groups(good).where("kept").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), D).columns == docs.columns
    rows = corpus_pipeline.run(spark, D).collect()
    assert rows and {r.doc_id for r in rows} <= kept
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048
