"""A small shell over the engine: python -m skein.cli FOLDER."""

from __future__ import annotations

import shlex
import sys

from skein.errors import SkeinError

HELP = "upload PATH | docs | info ID | delete ID | stats | help | quit; anything else is a question"


def answer_text(got: dict) -> str:
    lines = [got["answer"], f"(confidence {got['confidence']:.2f})"]
    lines += [f"  [{s['rank']}] {s['content'][:150]}" for s in got["sources"][:3]]
    return "\n".join(lines)


def respond(engine, line: str) -> str | None:
    """The answer to one line; None ends the session."""
    words = shlex.split(line) if line.startswith(("upload", "info", "delete")) else line.split()
    command = words[0].lower() if words else ""
    try:
        if command in ("quit", "exit"):
            return None
        if command == "help" and len(words) == 1:
            return HELP
        if command == "upload" and len(words) == 2:
            return f"added {engine.ingest_file(words[1])['document_id']}"
        if command == "docs":
            return "\n".join(f"{r.document_id[:8]} {r.filename} ({r.chunk_count} chunks)" for r in engine.documents().collect()) or "no documents"
        if command == "info" and len(words) == 2:
            return str(engine.document(words[1]))
        if command == "delete" and len(words) == 2:
            engine.delete(words[1])
            return "deleted"
        if command == "stats":
            return str(engine.stats())
        return answer_text(engine.query(line)) if line.strip() else HELP
    except SkeinError as e:
        return f"{e.code}: {e.message}"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from skein.engine import Engine

    engine = Engine(SparkSession.builder.appName("skein").getOrCreate(), argv[0] if argv else "skein-data")
    for line in sys.stdin:
        out = respond(engine, line.strip())
        if out is None:
            break
        print(out, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
