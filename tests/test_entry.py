"""The driver contract holds with and without the llm subpackage."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_llm(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "foliant", ".git"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "foliant")
    for name in os.listdir(f"{ROOT}/foliant"):
        if name != "llm":
            os.symlink(f"{ROOT}/foliant/{name}", tmp_path / "foliant" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)


def test_entry_without_a_library_of_the_operators(tmp_path):
    """A missing library takes the operators away and leaves the rest."""
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'op7_simhash' not in q"
    env = os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from foliant.session import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: "spark://host:7077" if name == "spark.master" else default)

    with pytest.raises(ValueError):
        shared_dir(Session)
