import random

import pytest

from strataquery.llm import line_quality
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, n_words string, removed_words string, host string, k_t1 string, facts string, row string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", "x", "x", "x", "x", "x") for d, t, s in rows], SCHEMA)


def check(spark, rows, **options):
    want = sorted((str(d), *f.values(), gone, kept) for (d, _, _), (f, gone, kept) in zip(rows, brute.verdicts([(t, s) for _, t, s in rows], **options)))
    got = line_quality.judge(table(spark, rows), **options)
    assert sorted((str(r["doc_id"]), *[r[c] for c in line_quality.RESULTS]) for r in got.collect()) == want
    kept = line_quality.clean(table(spark, rows), **options)
    assert kept.columns == table(spark, rows).columns
    facts, rest = brute.judged([(t, s) for _, t, s in rows], **options)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((str(d), t) for (d, _, _), (_, _, k), t in zip(rows, facts, rest) if k)
    return want


def line(rng, n=12):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_odd_texts(spark):
    rng = random.Random(0)
    long = " ".join(rng.choices(WORDS, k=30_000))
    texts = [None, "", " \n\t ", "a", "a\n\na\n a\nb", "\x0b\x0ca\x1cb c", "# * $ % & | < >", line(rng, 25), " ".join([line(rng, 9)] * 3), "x " * 40, line(rng, 8), long, "é É　漢", "A b\na  B"]
    rows = [(i, t, ["h", None, ""][i % 3]) for i, t in enumerate(texts)]
    check(spark, [*rows, *rows, (None, None, None)])


@pytest.mark.parametrize("seed", range(4))
def test_random_repeats(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        if rng.random() < 0.6:
            a = rng.randrange(len(words))
            words[rng.randrange(len(words)) : 0] = words[a : a + rng.randrange(6, 20)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), "h"))
    check(spark, rows)


def test_common_lines_deplete_documents_of_their_host(spark):
    rng = random.Random(5)
    banner = line(rng, 30)
    rows = [(i, banner + "\n" + line(rng, 25), "a") for i in range(40)]
    rows += [(100 + i, banner.upper() + " \n" + banner + "\n" + line(rng, 2), "a") for i in range(8)]  # nothing but the banner
    rows += [(200 + i, line(rng, 30), "a") for i in range(40)]
    rows += [(300, banner + "\n" + line(rng, 3), "b")]  # rare on its own host
    want = {w[0]: w[-1] for w in check(spark, rows)}
    assert not any(want[str(100 + i)] for i in range(8)) and want["0"] and want["300"]


@pytest.mark.parametrize("most", [0, 500_000])
def test_depleted_texts_go_with_and_without_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(line_quality, "BROADCAST_LINES", most)
    monkeypatch.setattr(line_quality, "SLOT", 1)
    rng = random.Random(7)
    banner = line(rng, 30)
    rows = [(i, banner + "\n" + line(rng, 3 + i % 25), "ab"[i % 2]) for i in range(90)] + [(200 + i, line(rng, 30), None) for i in range(30)]
    assert 0 < sum(not w[-1] for w in check(spark, rows)) < 90


def test_copies_of_one_text_are_one_document(spark):
    rng = random.Random(6)
    text = "\n".join(line(rng, 15) for _ in range(4))
    rows = [(i, text, "a") for i in range(200)] + [(1000 + i, line(rng, 30), "a") for i in range(30)]
    assert all(w[-1] for w in check(spark, rows))


def test_each_document_counts_if_asked(spark):
    rng = random.Random(6)
    text = "\n".join(line(rng, 15) for _ in range(4))
    rows = [(i, text, "a") for i in range(25)] + [(1000 + i, line(rng, 30), "a") for i in range(30)] + [(2000, text + "\n" + line(rng, 60), "a")]
    want = {w[0]: w[-1] for w in check(spark, rows, per="documents")}
    assert not want["0"] and want["1000"] and want["2000"]
    check(spark, rows, per="documents", share=0.5)
    with pytest.raises(ValueError):
        line_quality.judge(table(spark, rows), per="lines")


def test_the_limit_does_not_grow_with_the_host(spark):
    rng = random.Random(12)
    banner = line(rng, 30)
    rows = [(i, line(rng, 25), "a") for i in range(2000)] + [(5000 + i, banner + "\n" + line(rng, 4), "a") for i in range(21)]
    want = {w[0]: w[-1] for w in check(spark, rows)}
    assert not any(want[str(5000 + i)] for i in range(21)) and want["0"]


def test_lower_limits(spark):
    rng = random.Random(8)
    shared = line(rng, 40)
    rows = [(i, shared + "\n" + line(rng, 4), "a") for i in range(6)] + [(50 + i, line(rng, 30), "a") for i in range(6)]
    assert not any(w[-1] for w in check(spark, rows, least=3, share=0.3)[:6] if int(w[0]) < 50)


def test_stripping(spark):
    rng = random.Random(9)
    banner = "Common LINE of all"
    rows = [(i, f"{banner}\n{line(rng)}\n common  line of all", "a") for i in range(30)] + [(99, None, "a"), (98, "rest", None)]
    got = {r["doc_id"]: r["text"] for r in line_quality.strip_common_lines(table(spark, rows)).collect()}
    assert got[99] is None and got[98] == "rest"
    assert all(got[i] == rows[i][1].split("\n")[1] for i in range(30))


def test_empty_table(spark):
    assert line_quality.judge(table(spark, [(1, "a", "b")]).limit(0)).count() == 0
    assert line_quality.clean(table(spark, [(1, "a", "b")]).limit(0)).count() == 0


def test_query_matches_sql(spark, sf, duck):
    from strataquery.llm.queries import oracle_sql, queries

    got = queries()["op4_line_quality"](spark, sf)
    names = sorted(got.columns)
    found = duck.sql(oracle_sql()["op4_line_quality"])
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(found.select(*names).fetchall() if hasattr(found, "select") else found.fetchall())


def test_plan_has_no_python(spark, sf):
    from strataquery.llm.queries import op3_fair_mix, op4_line_quality, op9_link_trust

    for query in (op3_fair_mix, op4_line_quality, op9_link_trust):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
