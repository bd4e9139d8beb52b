import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from lotlens.operators.windows import global_tiles

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_training_text_package():
    code = "import sys; sys.modules['lotlens.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_tiles_with_ties_and_fewer_rows_than_tiles(spark):
    for n in (0, 1, 3, 7, 100):
        df = spark.range(n).selectExpr("id", "cast(id % 3 as double) as v")
        got = [r.tile for r in global_tiles(df, "v", "id", 5).orderBy("v", "id").collect()]
        order = sorted(range(n), key=lambda i: (-(i % 3), i))
        size, more = divmod(n, 5)
        want = [k + 1 for k in range(5) for _ in range(size + (k < more))]
        assert [t for _, t in sorted(zip([(i % 3, i) for i in order], want, strict=True))] == got
