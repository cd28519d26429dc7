from pathlib import Path
from types import SimpleNamespace

import pytest

from framewise.plans import cli
from framewise.plans import runtime as rt

from .test_media import movie, payload

STRUCTURE = "head\n 0 11 1 0 1 :L\n 12 23 1 2 0 :CM\n 24 59 1 0 1 :L\n"


def tools(index: str, trim: str, calls: list):
    """Detectors that copy canned results."""

    def runner(command, cwd: Path) -> rt.Result:
        calls.append(Path(str(command[0])).name)
        name = calls[-1]
        if name == "dtvindex":
            (cwd / command[3]).write_text(index)
        elif name == "join_logo_scp":
            (cwd / "trim.avs").write_text(trim)
            (cwd / "detail.jls").write_text(STRUCTURE)
        return rt.Result("dtvindex=enabled", "")

    return runner, lambda name: Path("/tools") / name


def arguments(tmp_path, **more):
    base = {"cache_dir": tmp_path / "cache", "jl_file": Path("x.txt"), "jls_set": [], "logo": None, "force": False, "analyze_only": False, "ignore_verdict": False, "no_subtitles": False, "cm_output": False, "verify": True}
    return SimpleNamespace(**base | more)


def test_everything_for_one_input(spark, tmp_path):
    source = tmp_path / "a.mp4"
    index, video, _ = movie(source)
    calls: list = []
    runner, tool = tools(index, "Trim(0,11) ++ Trim(24,59)", calls)
    assert cli.auto(spark, arguments(tmp_path), source, runner, tool) == rt.OK
    out = rt.cut_name(source, ".mp4")
    assert payload(out, "video")[0] == video[:12] + video[24:] and calls == ["dtvindex", "chapter_exe", "join_logo_scp"]
    assert cli.auto(spark, arguments(tmp_path), source, runner, tool) == rt.OK and len(calls) == 3
    out.unlink()
    runner, tool = tools(index, "Trim(0,59)", calls)
    assert cli.auto(spark, arguments(tmp_path), source, runner, tool) == rt.STOPPED and not out.exists()


def test_command_line(tmp_path, capsys):
    assert cli.main(["cut", str(tmp_path / "none.mp4"), "--trim", "x"]) == rt.ERROR and "error" in capsys.readouterr().err
    with pytest.raises(SystemExit) as e:
        cli.main(["cut"])
    assert e.value.code == rt.USAGE
    args = cli.parser().parse_args(["make-logo", "a.mp4", "--rect", "1,2,3,4", "-o", "o.lgd"])
    assert args.rect == (1, 2, 3, 4) and args.threshold == 12
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["make-logo", "a.mp4", "--rect", "1,2,3", "-o", "o.lgd"])


def test_the_library_stands_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).parent.parent
    shutil.copytree(root / "framewise", tmp_path / "framewise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(q.startswith('op') for q in e.queries()); assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
