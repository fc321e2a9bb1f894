"""Commands, requests, the lock and the repository around them."""

from __future__ import annotations

import io
import json
import subprocess

import pytest

from tarnwell import cli
from tarnwell.sources import repo


def test_commands_and_requests(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def one():\n    return two()\n\n\ndef two():\n    return 2\n")
    base = ["--root", str(tree), "--index", str(tmp_path / "index"), "--bank", str(tmp_path / "bank")]

    def run(*words: str) -> tuple[int, list]:
        out = io.StringIO()
        code = cli.main([*base, *words], spark, out)
        return code, [json.loads(x) if x[:1] in "{[" else x for x in out.getvalue().splitlines()]

    assert run("refresh") == (0, [{"new": 1}]) and run("refresh") == (0, [{"same": 1}])
    code, rows = run("callers", "two")
    assert code == 0 and rows[0]["qual"] == "one" and run("def", "none")[0] == 1 and run("nothing")[0] == 2
    assert run("path", "one > two") == (0, ["one", "two"]) and run("find", "two", "-k", "1")[1][0]["path"] == "a.py"
    assert run("handoff", "The function two returns a number that one passes on.", "--set", "task=t1", "--set", "role=dev")[0] == 0
    assert run("handoff", "x", "--set", "task=../x", "--set", "role=dev")[0] == 2
    assert [r["section"] for r in run("loadout", "--set", "task=t1")[1]] == ["task"]
    assert run("memory", "stats")[1][0]["notes"] == 1 and run("memory", "path")[1] == [str(tmp_path / "bank")]
    requests = "\n".join(["no json", json.dumps({"id": 1, "tool": "find", "args": {"words": "two"}}), json.dumps({"id": 2, "tool": "hack"}), json.dumps({"id": 3, "tool": "recall", "args": {"words": "number"}}), ""])
    out = io.StringIO()
    cli.serve(cli.Commands(cli.Engine(spark, str(tree), str(tmp_path / "index")), cli.Bank(spark, str(tmp_path / "bank"))), io.StringIO(requests), out)
    a, b, c, d = map(json.loads, out.getvalue().splitlines())
    assert "error" in a and b["id"] == 1 and b["result"] and "error" in c and d["result"][0]["id"] == "n000001"
    with pytest.raises(cli.Wrong):
        cli.Commands(None, None, "graph,other")
    with pytest.raises(cli.Wrong):
        cli.Commands(None, None, "search").run("def", {"words": "x"})


def test_lock(tmp_path):
    a, b = repo.Lock(str(tmp_path / "l")), repo.Lock(str(tmp_path / "l"))
    with a:
        assert a.held() and not b.acquire() and not b.held()
    assert b.acquire()
    late = repo.Lock(str(tmp_path / "l"), expiry=-1)
    assert late.acquire() and late.held() and not b.held()
    b.release()
    assert late.held()


def test_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.com", *a], check=True, capture_output=True)
    (tmp_path / "sub").mkdir()
    git("init", "-q")
    for name in ("a.py", "sub/b.py"):
        (tmp_path / name).write_text("x = 1\n")
        git("add", "-A")
        git("commit", "-qm", f"add {name}")
    assert repo.root_of(str(tmp_path / "sub")) == str(tmp_path.resolve())
    assert [(r.subject, r.files) for r in repo.history(spark, str(tmp_path)).orderBy("at", "subject").collect()] == [("add a.py", ["a.py"]), ("add sub/b.py", ["sub/b.py"])]
    git("worktree", "add", "-q", str(tmp_path / "wt"), "-b", "other")
    assert repo.identity(str(tmp_path / "wt")) == repo.identity(str(tmp_path)) and repo.index_dir(str(tmp_path), "/x/").startswith("/x/")
    with pytest.raises(PermissionError):
        repo.guard(str(tmp_path), 1, home=str(tmp_path / "sub"))
    with pytest.raises(PermissionError):
        repo.guard(str(tmp_path), 20_001, home="/nowhere")
    (tmp_path / repo.SKIP_FILE).write_text("")
    with pytest.raises(PermissionError):
        repo.guard(str(tmp_path), 1, home="/nowhere")
