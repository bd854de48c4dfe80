"""Registered queries against their SQL on the smallest tables, and edge rows of single operators."""

import math
import random
from pathlib import Path

import duckdb
import pytest

from factloom.functions.scalars import canonical_label, localized_amount, round_up, slug
from factloom.operators import audit, consolidation, finance, lifecycle, meaning, retrieval
from factloom.plans.queries import ORACLES, QUERIES
from factloom.streaming import jobs

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool | str):
        return str(x)
    return f"{float(x):.8g}" if isinstance(x, int | float) or hasattr(x, "as_integer_ratio") else str(x)


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        base.sql(f"create view {path.stem} as select * from '{path}'")
    got = QUERIES[name](spark, str(DATA))
    want = base.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted("|".join(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall())


def test_tolerance_buckets_and_ladder(spark):
    rows = [
        ("1", "invoice", "Acme ", "2024-01", None, '{"record":"R","total":100}', 0.5, "2024-01-01 00:00:00"),
        ("2", "invoice", "acme", "2024-01", None, '{"record":"R","total":100.4}', 0.5, "2024-01-09 00:00:00"),
        ("3", "invoice", "ACME", "2024-01", None, '{"record":"R","total":200,"refs":["X","R"]}', 0.5, "2024-01-05 00:00:00"),
        ("4", "invoice", "other", "2024-01", None, '{"record":"R","total":900}', 0.5, "2024-01-05 00:00:00"),
        ("5", "invoice", "acme", None, "S", '{"ok":true,"n":{"a":1}}', 0.5, "2024-01-05 00:00:00"),
        ("6", "invoice", "acme", None, None, None, 0.5, "2024-01-05 00:00:00"),
    ]
    frame = spark.createDataFrame(rows, "id string, kind string, company string, period string, source_ref string, metadata string, importance double, created_at string").withColumn("created_at", audit.F.to_timestamp("created_at"))
    found = audit.contradictions(frame).collect()
    assert [(r.subject, r.attr, r.n_buckets, r.n_carriers, r.winner_id, r.rule) for r in found] == [("R", "total", 2, 3, "2", "recency")]
    assert [r.ref for r in audit.dangling_references(frame).collect()] == ["X"]
    assert audit.contradictions(frame.limit(0)).count() == 0


def test_scalars(spark):
    amounts = ["(1.234,56) EUR", "1'234.50", "1,234", "12,5", "-3.00", "x", "1,234,567", None]
    frame = spark.createDataFrame([(a,) for a in amounts], "a string")
    assert [r[0] for r in frame.select(localized_amount(audit.F.col("a"))).collect()] == [-1234.56, 1234.5, None, 12.5, -3.0, None, 1234567.0, None]
    one = spark.createDataFrame([("  Acme   Foods ", -2.5)], "n string, x double")
    assert tuple(one.select(canonical_label(audit.F.col("n")), slug(audit.F.col("n")), round_up(audit.F.col("x"), 0)).first()) == ("acme foods", "acme-foods", -2.0)


def test_forget_and_append(spark):
    memories = spark.createDataFrame([("1", "2020-01-01", 0.1, None), ("2", "2020-01-01", 0.9, None), ("3", "2024-01-01", 0.1, "2024-01-02"), ("4", None, 0.1, None)], "id string, created_at string, importance double, superseded_at string")
    memories = memories.withColumns({c: audit.F.to_timestamp(c) for c in ("created_at", "superseded_at")})
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(lifecycle.plan_forget(memories, "2024-02-01")) == []
    assert ids(lifecycle.plan_forget(memories, "2024-02-01", True, 30, 0.5)) == ["1", "3"]
    stored = spark.createDataFrame([("a", "t", "k1", 1), ("b", "t", "k2", 1)], "id string, tenant_id string, idempotency_key string, v int")
    batch = spark.createDataFrame([("c", "t", "k1", 1), ("d", "t", "k2", 2), ("e", "t", "k3", 1), ("f", "t", None, 1), ("g", "t", None, 1)], stored.schema)
    new, replays, conflicts = lifecycle.idempotent_append(stored, batch, ["v"])
    assert ids(new) == ["e", "f", "g"] and [r.stored_id for r in replays.collect()] == ["a"] and [r.idempotency_key for r in conflicts.collect()] == ["k2"]


def test_fused_event_passes_its_rules(spark):
    slip = "struct<employee_id:string,name:string,gross:double,employee_social_security:double,tax:double,net:double,employer_social_security:double,employer_cost:double>"
    schema = f"doc_id string, doc_type string, company string, period string, currency string, event_ref string, payment_date string, gross_pay_total double, employer_cost_total double, employer_social_security_total double, net_pay_total double, employee_count int, payslip {slip}"
    none = [None] * 5
    rows = [
        ("d1", "register", "Acme", "2026-05", "EUR", None, None, 12000.0, 14600.0, None, None, 3, None), ("d2", "bank", "acme ", "2026-05", None, None, "2026-05-27", None, None, None, 10800.0, None, None),
        *[(f"s{i}", "payslip", "Acme", "2026-05", "EUR", None, None, *none, (f"e{i}", "n", 4000.0, 200.0, 200.0, 3600.0, 866.67, 4866.67)) for i in range(3)],
        *[(f"c{i}", kind, "Clash", "2026-05", "EUR", None, None, gross, cost, None, net, None, ("E1 " if i else "e1", "n", 10.0 + i * (kind == "payslip"), 0.0, 0.0, 9.0, 1.0, 11.0) if kind == "payslip" else None)
          for i, (kind, gross, cost, net) in enumerate([("payslip", None, None, None), ("payslip", None, None, None), ("register", 10.0, 11.0, None), ("bank", None, None, 9.0)])],
        ("x1", "bank", "Solo", "2026-05", "EUR", None, None, None, None, None, 5.0, None, None),
    ]
    events, rejected = finance.fuse_events(spark.createDataFrame(rows, schema))
    event = events.collect()
    assert len(event) == 1 and event[0].off_bank_cost == 3800.0 and event[0].linked_docs == ["d1", "d2", "s0", "s1", "s2"]
    assert {r.rule: r.status for r in finance.validation_rules(events).collect()} == {f"R{i}": "passed" for i in range(1, 7)}
    assert sorted((r.company, r.reason) for r in rejected.collect()) == [("clash", "conflicting_payslip"), ("solo", "missing_register")]


def test_polarity_and_figures(spark):
    texts = ["Always paid on time.", "They do not pay on time", "unpaid", None, "never late", "Payment was never overdue but the account is closed"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    signs = [r[0] for r in frame.select(meaning.polarity(audit.F.col("t"))).collect()]
    assert [(s[0], s[1], s[5]) for s in signs] == [(1, 1, 0), (-1, 0, 0), (0, -1, 0), (0, 0, 0), (1, 0, 0), (1, 0, -1)]
    answers = spark.createDataFrame([(1, "1,200 and 3.5, then 7"), (2, None)], "query_id long, text string")
    evidence = spark.createDataFrame([(1, "it was 1200"), (1, "7 7"), (2, "9")], "query_id long, text string")
    assert sorted(tuple(r) for r in meaning.figure_traceability(answers, evidence).collect()) == [(1, 3, 2), (2, 0, 0)]
    vectors = meaning.hash_embed(spark.createDataFrame([(1, "a a b"), (2, None)], "id long, text string"), 64).collect()
    assert sorted(round(sum(x * x for x in r.embedding), 9) for r in vectors) == [0.0, 1.0] and all(len(r.embedding) == 64 for r in vectors)


@pytest.mark.parametrize("fold", [2, 500])
def test_complete_links_equal_the_plain_scan(spark, monkeypatch, fold):
    monkeypatch.setattr(consolidation, "FOLD", fold)
    deal = random.Random(7)
    pairs = {(a, b) for a in range(24) for b in range(a + 1, 24) if deal.random() < 0.3 or b < 8}
    clusters = []
    for i in range(24):
        home = next((c for c in clusters if all((j, i) in pairs for j in c)), None)
        home.append(i) if home else clusters.append([i])
    want = {i: c[0] for c in clusters for i in c}
    got = consolidation.complete_links(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()
    assert len(got) == 24 and {r.id: r.cluster for r in got} == want
    assert consolidation.complete_links(spark.createDataFrame([], "a long, b long")).count() == 0


def test_consolidation_winners(spark):
    rows = [(1, "x", 0.5, [1.0, 0.0]), (2, "x", 0.9, [1.0, 0.0]), (3, "x", 0.9, [1.0, 0.01]), (4, "y", 0.1, [1.0, 0.0]), (5, "x", 1.0, [0.0, 0.0]), (6, "x", 1.0, None), (7, "x", None, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r[:3], None, r[3]) for r in rows], "id long, scope_key string, importance double, created_at timestamp, embedding array<double>")
    assert sorted(tuple(r) for r in consolidation.plan_consolidation(frame, ["scope_key"]).collect()) == [(2, 1), (2, 3), (2, 7)]


def test_streams(spark, tmp_path):
    schema = "id string, tenant_id string, kind string, company string, period string, source_ref string, metadata string, importance double, created_at timestamp, superseded_at timestamp"
    values = [("1", 10), ("2", 10.2), ("3", 99)]
    for i, total in values:
        one = spark.createDataFrame([(i, "t", "k", "Acme", "p", "R", f'{{"total":{total}}}', 0.1, None, None)], schema)
        one.withColumn("created_at", audit.F.lit(f"202{i}-01-01").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    alerts = jobs.contradiction_alerts(stream()).format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert alerts.awaitTermination(120)
    assert {(r.subject, r.attr) for r in spark.table("alerts").collect()} == {("R", "total")}
    kept = jobs.retention(stream(), str(tmp_path / "out"), "2024-01-01", older_than_days=400, max_importance=0.5).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert kept.awaitTermination(120)
    last = max((p for p in (tmp_path / "out").iterdir()), key=lambda p: int(p.name))
    assert [r.id for r in spark.read.parquet(str(last)).collect()] == ["3"]


def test_conjunctive_asks_for_every_term(spark, tmp_path):
    """The first question's fourth term decides; repeated terms count once."""
    spark.createDataFrame([(1, "a b c d"), (2, "a b c"), (3, "d c b a e"), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100, 1, "a b c d a"), (100, 2, "a b c z"), (100, 3, None), (7, 1, "a")], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in QUERIES["lexical_conjunctive_all"](spark, str(tmp_path)).collect()] == [(100001, 2, 1)]


def test_metrics_count_all_gold(spark):
    ranked = spark.createDataFrame([(0, 0, 1), (0, 3, 2), (0, 1, 3), (100, 2, 1), (200, 4, 1)], "query_id long, id long, rank int")
    corpus = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, "y"), (4, None), *[(i, "x") for i in range(5, 11)]], "id long, label string")
    asked = spark.createDataFrame([(0, "x"), (100, "y"), (200, None)], "query_id long, label string")
    found = {r.query_id: r for r in retrieval.ir_metrics_by_label(ranked, asked, corpus, 5).collect()}
    pairs = asked.join(corpus, "label").select("query_id", "id")
    assert found == {r.query_id: r for r in retrieval.ir_metrics(ranked, pairs, 5).collect()}
    assert set(found) == {0, 100} and found[0].recall == 2 / 9 and found[100].recall == 0


def test_hybrid_pools_equal_brute_force(spark, tmp_path):
    """Two pools of 20 and the choice of 5, by a plain scan. Of the last question, BM25 alone finds document 95."""
    deal = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(deal.choices(words, k=deal.randint(1, 25))) for i in range(60)} | {60: None, 61: "rare " + "w1 " * 80, 95: "rare zeta"} | {i: "hub" for i in range(70, 95)}
    asked = {100001: "rare w2 w3", 100002: "w4 w5 w5 w6 w7", 200001: "nothing", 200002: "rare", 300001: "hub rare"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(q // 1000, q % 1000, t) for q, t in asked.items()], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))

    def bucket(word):
        h = 2166136261
        for c in word:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return min(h, 2**32 - h) % 256

    def vector(text):
        v = [0.0] * 256
        for word in (text or "").split():
            v[bucket(word)] += 1
        size = math.sqrt(sum(x * x for x in v)) or 1
        return [x / size for x in v]

    split = {i: (t or "").split() for i, t in texts.items()}
    average = sum(map(len, split.values())) / len(split)
    vectors = {i: vector(t) for i, t in texts.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))

    def score(question, own):
        total = 0.0
        for term in question.split():
            tf, df = own.count(term), sum(term in other for other in split.values())
            total += math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / average))
        return round(total, 9)

    want, dense_only = {}, {}
    first = lambda scores, k: sorted(scores, key=lambda i: (-scores[i], i))[:k]
    for query, text in asked.items():
        near = {i: round(dot(vector(text), v), 9) for i, v in vectors.items()}
        dense, lexical = first(near, 20), first({i: score(text, own) for i, own in split.items()}, 20)
        fused = {i: round(sum(1 / (61 + pool.index(i)) for pool in (dense, lexical) if i in pool), 9) for i in {*dense, *lexical}}

        def choose(left):
            out = []
            while len(out) < 5:
                gains = [0.7 * near[i] - 0.3 * max([0.0, *(dot(vectors[i], vectors[j]) for j in out)]) for i in left]
                out.append(left.pop(max(range(len(left)), key=lambda at: (round(gains[at], 9), -at))))
            return out

        want[query], dense_only[query] = choose(first(fused, 20)), choose(dense)
    got = {}
    for r in sorted(QUERIES["retrieve_hybrid_mmr"](spark, str(tmp_path)).collect()):
        got.setdefault(r.query_id, {})[r.rank] = r.id
    assert {q: [ids[rank] for rank in range(1, 6)] for q, ids in got.items()} == want
    assert 95 in want[300001] and 95 not in dense_only[300001]
