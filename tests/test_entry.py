import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_the_rest_works_without_the_llm_folders(tmp_path):
    for p in ("__spark_entry__.py", "ocuspark"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "ocuspark" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'diff_velocity' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path)
    for p in (tmp_path / "ocuspark").rglob("*.py"):
        assert "llm" not in p.read_text()
