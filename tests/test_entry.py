import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 55


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_runs_without_the_subpackage():
    import ast
    from pathlib import Path

    home = Path(entry.__file__).parent / "kinweave"
    for p in home.rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("kinweave.llm") for n in names), p


def test_entry_of_a_copy_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    home = Path(entry.__file__).parent
    shutil.copytree(home / "kinweave", tmp_path / "kinweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'p6_found' in q and 'p1_found' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 55, out.stderr
