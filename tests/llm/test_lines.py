import time
from collections import defaultdict

from sieveline.llm.line_runs import LineRuns, dedup_lines

LONG = "a line of at least forty characters that repeats"
BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    last = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_against_brute_force(spark):
    rows = [(i, f"own line {i}\n {LONG}\r\nshort\n{LONG.upper()}\t") for i in range(6)] + [(9, None), (10, ""), (11, "\n\n"), (12, "É" * 40), (13, f"{LONG} four")]
    rows += [(20 + i, f"{LONG} four") for i in range(3)] + [(30 + i, "x" * 39 + " ") for i in range(6)] + [(40, "\n".join([LONG] * 500)), (5, f"{LONG}\nother text, same id")]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, gone string, n_lines int")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "gone", "n_lines", "_n_lines", "n_dropped"]
    assert sorted((r.doc_id, r._n_lines, r.n_dropped, r.text) for r in got.collect()) == brute(rows)


def test_rows_without_ids_keep_no_repeated_line(spark):
    docs = spark.createDataFrame([(None, LONG), *((i, LONG) for i in range(5))], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == {None: "", 0: "", 1: "", 2: "", 3: "", 4: LONG}


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_compact_and_tell_new_keys(spark):
    runs = LineRuns(spark, fanout=2)
    seen = set()
    for n in range(5):
        batch = [(10 * n + i, h, h) for i in range(3) for h in (n, n + i, 100)]
        new = runs.add(spark.createDataFrame(batch, "doc_id long, hi long, lo long"))
        own = {h for _, h, _ in batch}
        assert {r.hi for r in new.collect()} == own - seen
        seen |= own
    assert all(len(level) < 2 for level in runs.levels) and len(runs.levels) == 3
    common = {r.hi: (r.n_docs, r.last_id) for r in runs.keys().collect()}
    assert common[100] == (15, 42) and set(common) == seen
    # Each key is in one run; what later batches add to it is in their increments.
    assert sorted(r.hi for run in runs.runs() for r in run.collect()) == sorted(seen)
    assert {(r.hi, r.n_docs, r.last_id) for r in runs.repeated(3).collect()} == {(h, *v) for h, v in common.items() if v[0] >= 3}
    # A batch meets a run in its buckets: the run isn't dealt out anew.
    first = runs.runs()[0]
    plan = spark.range(9).selectExpr("id AS hi", "id AS lo").distinct().join(first.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]


def test_long_texts_take_time_in_proportion_to_their_lines(spark):
    took = []
    for n in (8_000, 80_000):
        docs = spark.createDataFrame([(i, "\n".join(f"{LONG} {k}" for k in range(n))) for i in range(6)], "doc_id long, text string")
        began = time.time()
        rows = {r.doc_id: r for r in dedup_lines(docs).collect()}
        took.append(time.time() - began)
        assert all(rows[i].text == "" and rows[i].n_dropped == n for i in range(5)) and rows[5].n_dropped == 0
    assert took[1] < 10 * took[0] + 5


def test_rows_of_an_id_with_different_texts(spark):
    docs = spark.createDataFrame([*((i, LONG) for i in range(6)), (2, f"{LONG}\nand more"), (2, LONG)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in dedup_lines(docs).collect())
    assert got == sorted([(0, ""), (1, ""), (2, ""), (2, ""), (2, "and more"), (3, ""), (4, ""), (5, LONG)])
