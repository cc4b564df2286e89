"""Check portfolios: phases of runners against a plain reading, checks that check nothing, and how often each runs."""

from __future__ import annotations

import random

from treeline.operators import quality


def lines(spark, files):
    rows = [(repo, path, n, line) for repo, path, text in files for n, line in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "repo string, rel_path string, line_no int, line string")


def plain_phases(text):
    """line, phase and joined text of what stands within phases."""
    phase, kept, first, found = "", [], 0, []
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if line == "fi" or line.startswith("if selected ") and line[12:].split(";")[0].isalpha() and ";" in line:
            phase, kept = ("" if line == "fi" else line[12:].split(";")[0]), []
        elif phase:
            first = n if not kept else first
            kept.append(line[:-1] if line.endswith("\\") else line)
            if not line.endswith("\\"):
                found.append((first, phase, " ".join(kept)))
                kept = []
    return found


def test_logical_lines_against_plain_reading(spark):
    rng = random.Random(5)
    pieces = ["if selected a; then", "  if selected bc;", "if selected ; x", "fi", " fi ", "x \\", "\\", "y", "", "pytest t \\", "fi;", "if selected a"]
    files = [("r" if n % 2 else "s", f"run-{n}.sh", "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for n in range(60)]
    got = quality.logical_lines(lines(spark, files))
    want = [(repo, path, *x) for repo, path, text in files for x in plain_phases(text)]
    assert sorted(map(tuple, got.select("repo", "rel_path", "line_no", "phase", "line").collect())) == sorted(want) and len(want) > 50


def test_checks_that_check_nothing(spark):
    runner = "if selected a-1; then\npytest x/tests/t.py test/u.py -k 'p and q'\npytest tests/t.py -q\npytest -k 'x'\necho tests/t.py -k 'x'\nfi\npytest tests/t.py -k 'out'"
    checker = "assert len(f.x) != 3\n # len(x) != 3\nlen(x) == 3\nif len( rows ) !=12: pass\ngrep a $ROOT/lib | rg b ${ROOT}/gone.txt\ngrep a lib/x.py; grep b \"$ROOT/lib/x.py\" && grep c $ROOT/lib/\nrg b $ROOT/other.py"
    files = spark.createDataFrame([("r", "lib/x.py"), ("s", "other.py")], "repo string, rel_path string")
    got = quality.vacuous_checks(lines(spark, [("r", "run.sh", runner)]), lines(spark, [("r", "check.py", checker)]), files).collect()
    assert sorted((r.rel_path, r.line_no, r.kind, r.phase, tuple(r.targets), r.detail) for r in got) == [
        ("check.py", 1, "hardcoded_constant", None, (), "assert len(f.x) != 3"),
        ("check.py", 4, "hardcoded_constant", None, (), "if len( rows ) !=12: pass"),
        ("check.py", 5, "vacuous_scan", None, (), "gone.txt"),
        ("check.py", 7, "vacuous_scan", None, (), "other.py"),
        ("run.sh", 2, "pytest_selector", "a-1", ("t.py", "u.py"), "p and q"),
    ]
    empty = lines(spark, [("r", "run.sh", "")]).limit(0)
    assert quality.vacuous_checks(empty, empty, files).count() == 0


def test_executions_by_repository(spark):
    text = "bash a/check_x.sh\n# bash a/check_x.sh\nsee a/check_x.sh\nsh bash 'a/check_x.sh' python3 b/check_y.py\nstep one a/check_x.sh\nstep one two a/check_x.sh\nnotbash a/check_x.sh\nspawn one ${PY} \"b/check_y.py\"\nbash a/check_x.sh.bak\nnode check_y.py now"
    checkers = spark.createDataFrame([("r", "a/check_x.sh", "check_x.sh"), ("r", "b/check_y.py", "check_y.py"), ("r", "z.sh", "z.sh"), ("s", "a/check_x.sh", "check_x.sh")], "repo string, path string, name string")
    registered = spark.createDataFrame([("s", "a/check_x.sh")], "repo string, path string")
    runner = lines(spark, [("r", "run.sh", text)])
    got = quality.executions(runner, checkers, registered)
    assert sorted(map(tuple, got.collect())) == [("r", "a/check_x.sh", "check_x.sh", 3, "duplicate"), ("r", "b/check_y.py", "check_y.py", 3, "duplicate"), ("r", "z.sh", "z.sh", 0, "never"), ("s", "a/check_x.sh", "check_x.sh", 1, "once")]
    assert sorted(map(tuple, quality.executions(runner.limit(0), checkers.select("name").distinct()).collect())) == [("check_x.sh", 0, "never"), ("check_y.py", 0, "never"), ("z.sh", 0, "never")]
