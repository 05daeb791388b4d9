from pathlib import Path

from sieveline.llm.line_runs import dedup_lines
from sieveline.llm.runtime import shared_dir


def test_no_table_is_written_that_nothing_reads(spark):
    root = Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.iterdir())
    line = "a line that is long enough to count as a repeated one"
    out = dedup_lines(spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(8)], "doc_id long, text string"))
    assert sorted(r.text for r in out.collect()) == sorted([*(f"own {i}" for i in range(7)), f"{line}\nown 7"])
    names = {p.name for p in set(root.iterdir()) - before}
    assert any(n.startswith("line-runs") for n in names) and not any(n.startswith("new-lines") for n in names)
