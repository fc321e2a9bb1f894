"""Commands over an engine and a bank, and a loop of JSON requests, one a line, over the same commands.

    python -m tarnwell.cli --root TREE --index FOLDER [--bank FOLDER] COMMAND [words...]
    python -m tarnwell.cli --root TREE --index FOLDER serve < requests

Exit codes: 0 an answer, 1 nothing found, 2 a wrong request, 3 a refused folder or a held lock.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.bank import Bank
from tarnwell.engine import DEPTH, FIND, HUBS, PACK, Engine
from tarnwell.operators.memory import budget_floor
from tarnwell.sources import repo

RECALL, RECALL_TOKENS, LIST, LOADOUT, REQUEST_BYTES, HANDOFF_BYTES = 8, 400, 20, 600, 1 << 20, 64 << 10
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}\Z")
TOOLS = ("ask", "find", "recall", "retain", "pack", "handoff", "loadout")


class Wrong(ValueError):
    """A request that cannot be understood."""


def checked_name(name: str) -> str:
    """Names of banks, tasks and roles."""
    if not NAME.match(name) or ".." in name:
        raise Wrong(f"{name!r} is no name")
    return name


class Commands:
    """Every command returns rows as dictionaries, or lines. ``engines``: which parts are on (TARNWELL_ENGINES: graph, search, memory)."""

    def __init__(self, engine: Engine, bank: Bank | None = None, engines: str | None = None):
        self.engine, self.bank = engine, bank
        on = engines if engines is not None else os.environ.get("TARNWELL_ENGINES", "graph,search,memory")
        self.on = {x.strip() for x in on.split(",") if x.strip()}
        if not self.on <= {"graph", "search", "memory"}:
            raise Wrong(f"engines are graph, search and memory, not {on}")

    def _part(self, part: str) -> None:
        if part not in self.on or (part == "memory" and self.bank is None):
            raise Wrong(f"{part} is off")

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def run(self, name: str, args: dict) -> list:
        """One command by name; unknown commands and arguments are wrong requests."""
        f: Callable | None = getattr(self, f"do_{name}", None)
        if f is None:
            raise Wrong(f"no command {name!r}")
        try:
            return f(**args)
        except TypeError as e:
            raise Wrong(str(e)) from e

    def do_refresh(self) -> list:
        with repo.Lock(f"{self.engine.at.removeprefix('file://')}.lock"):
            return [self.engine.refresh()]

    def do_status(self) -> list:
        return [self.engine.status()]

    def _graph(self, name: str, *args: object) -> list:
        self._part("graph")
        return self._rows(getattr(self.engine, name)(*args))

    def do_def(self, words: str) -> list:
        return self._graph("def_", words)

    def do_callers(self, words: str) -> list:
        return self._graph("callers", words)

    def do_about(self, words: str) -> list:
        return self._graph("about", words)

    def do_explain(self, words: str) -> list:
        return self._graph("explain", words)

    def do_affected(self, words: str, depth: int = DEPTH) -> list:
        return self._graph("affected", words, depth)

    def do_hubs(self, k: int = HUBS) -> list:
        return self._graph("hubs", k)

    def do_map(self) -> list:
        return self._graph("map")

    def do_query(self, words: str, budget: int = 600) -> list:
        return self._graph("query", words, budget)

    def do_path(self, words: str) -> list:
        self._part("graph")
        a, _, b = words.partition(">")
        return self.engine.path(a.strip(), b.strip())

    def do_find(self, words: str, k: int = FIND) -> list:
        self._part("search")
        return self._rows(self.engine.find(words, k))

    def do_ask(self, questions: list) -> list:
        """Questions ['kind words', ...]; with a bank, notes about all of them follow."""
        pairs = [(q.partition(" ")[0], q.partition(" ")[2].strip()) for q in questions]
        try:
            out: list = [{"kind": k, "words": w, "rows": [r if isinstance(r, str) else r.asDict(recursive=True) for r in rows]} for k, w, rows in self.engine.ask([p for p in pairs if p[0] != "recall"])]
        except ValueError as e:
            raise Wrong(str(e)) from e
        if self.bank is not None and "memory" in self.on:
            out.append({"kind": "recall", "rows": self._rows(self.bank.recall(" ".join(w for _, w in pairs), 4, 200))})
        return out

    def do_pack(self, words: str, budget: int = PACK) -> list:
        return self.engine.pack(words, budget_floor(budget), self.bank if "memory" in self.on else None)

    def do_retain(self, text: str, kind: str = "world", tags: list | None = None) -> list:
        self._part("memory")
        rows = self.engine.spark.createDataFrame([(kind, text, tags or [])], "kind string, text string, tags array<string>").withColumn("mentioned_at", F.timestamp_seconds(F.lit(self.bank.clock())))
        try:
            return self._rows(self.bank.retain(rows).select("id", "kind", "text"))
        except ValueError as e:
            raise Wrong(str(e)) from e

    def do_recall(self, words: str, limit: int = RECALL, tokens: int = RECALL_TOKENS) -> list:
        self._part("memory")
        return self._rows(self.bank.recall(words, limit, tokens))

    def do_reflect(self, words: str) -> list:
        self._part("memory")
        got, by_entity = self.bank.reflect(words)
        return [{"notes": self._rows(got), "entities": self._rows(by_entity)}]

    def do_memory(self, action: str = "list", ids: list | None = None, k: int = LIST) -> list:
        self._part("memory")
        if action == "forget":
            return [{"forgotten": self.bank.forget(ids or [])}]
        if action == "path":
            return [self.bank.path]
        if action not in ("list", "stats"):
            raise Wrong("memory list, forget, stats or path")
        return self._rows(self.bank.stats()) if action == "stats" else self._rows(self.bank.list(k).select("id", "kind", "text", "tags", "proof_count"))

    def do_handoff(self, text: str, task: str, role: str) -> list:
        """A finding kept for a task, by a role; '-' reads the text from standard input."""
        text = sys.stdin.buffer.read(HANDOFF_BYTES + 1).decode("utf-8", "replace") if text == "-" else text
        if len(text.encode()) > HANDOFF_BYTES:
            raise Wrong(f"a handoff has at most {HANDOFF_BYTES} bytes")
        return self.do_retain(text, "experience", [f"task:{checked_name(task)}", f"from:{checked_name(role)}"])

    def do_loadout(self, task: str, words: str = "", tokens: int = LOADOUT) -> list:
        """What a task begins with: directives (up to a third), what was filed for it, and up to four related notes (up to a third)."""
        self._part("memory")
        tokens = budget_floor(tokens)
        core = self._rows(self.bank.recall(words or task, 20, tokens // 3, kinds=["directive"]))
        filed = self._rows(self.bank.recall(words or task, 20, tokens, tags=[f"task:{checked_name(task)}"]))
        seen = {r["id"] for r in core + filed}
        related = [r for r in self._rows(self.bank.recall(words or task, 8, tokens // 3)) if r["id"] not in seen][:4]
        out, left = [], tokens
        for section, rows in (("core", core), ("task", filed), ("related", related)):
            for n, r in enumerate(rows):
                cost = -(-len(r["text"].encode()) // 4)
                if cost > left:
                    out.append({"section": section, "more": len(rows) - n})
                    break
                left -= cost
                out.append({"section": section, "id": r["id"], "text": r["text"]})
        return out


def serve(commands: Commands, lines: TextIO, out: TextIO) -> None:
    """Answer JSON requests {id, tool, args}, one a line; the index is brought up to date before each. A line that is too long, no
    JSON or wrong gets an error and the loop goes on."""
    for line in lines:
        if not line.strip():
            continue
        key = None
        try:
            if len(line.encode()) > REQUEST_BYTES:
                raise Wrong(f"a request has at most {REQUEST_BYTES} bytes")
            asked = json.loads(line)
            key = asked.get("id")
            if asked.get("tool") not in TOOLS:
                raise Wrong(f"tools are {', '.join(TOOLS)}")
            commands.do_refresh()
            answer = {"id": key, "result": commands.run(asked["tool"], asked.get("args") or {})}
        except (Wrong, json.JSONDecodeError, AttributeError, BlockingIOError) as e:
            answer = {"id": key, "error": str(e)}
        out.write(json.dumps(answer, default=str) + "\n")
        out.flush()


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: TextIO = sys.stdout) -> int:
    p = argparse.ArgumentParser(prog="tarnwell")
    p.add_argument("--root", required=True)
    p.add_argument("--index", required=True)
    p.add_argument("--bank")
    p.add_argument("command")
    p.add_argument("words", nargs="*")
    p.add_argument("-k", type=int)
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    from tarnwell.session import build
    from tarnwell.sources.tree import walk

    spark = spark or build()
    try:
        repo.guard(a.root, len(walk(a.root)) if os.path.isdir(a.root) else 0)
        commands = Commands(Engine(spark, a.root, a.index), Bank(spark, a.bank) if a.bank else None)
        if a.command == "serve":
            serve(commands, sys.stdin, out)
            return 0
        args: dict = {} if a.k is None else {"k": a.k}
        for s in a.set:
            name, _, value = s.partition("=")
            args[name] = int(value) if value.lstrip("-").isdigit() else value
        if a.words:
            args |= {"questions": a.words} if a.command == "ask" else {"text": " ".join(a.words)} if a.command in ("retain", "handoff") else {"action": a.words[0], "ids": a.words[1:]} if a.command == "memory" else {"words": " ".join(a.words)}
        rows = commands.run(a.command, args)
    except Wrong as e:
        print(e, file=sys.stderr)
        return 2
    except (PermissionError, BlockingIOError) as e:
        print(e, file=sys.stderr)
        return 3
    for r in rows:
        out.write((r if isinstance(r, str) else json.dumps(r, default=str)) + "\n")
    return 0 if rows else 1


if __name__ == "__main__":
    raise SystemExit(main())
