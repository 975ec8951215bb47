import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.llm import registry

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = registry.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 11))
    assert set(names) <= set(entry.queries()) and "pipeline" in entry.queries() and set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF).select([d[0] for d in found.description])
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_entry_without_this_subpackage(tmp_path):
    """The rest imports where the subpackage and the pipeline are missing."""
    root = Path(entry.__file__).resolve().parent
    for path in root.rglob("*.py"):
        inside = path.relative_to(root)
        if "llm" not in inside.parts and inside.name != "corpus_pipeline.py" and inside.parts[0] != "tests":
            os.makedirs((tmp_path / inside).parent, exist_ok=True)
            (tmp_path / inside).write_bytes(path.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.parametrize(("missing", "lost"), [("sentencepiece", {"op8_sentencepiece", "pipeline"}), ("xxhash", {"op2_ngram_join", "pipeline"})])
def test_a_missing_library_takes_no_other_query_with_it(missing, lost):
    root = str(Path(entry.__file__).resolve().parent)
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, check=True, capture_output=True, text=True)
    assert set(entry.queries()) - set(out.stdout.split()) == lost and "left out" in out.stderr
