"""Driver-side helpers around an index: hub files, restore points, summaries, renderings and reports."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generations import Store, validate

MAX_POINTS = 100


def slug(text: str, default: str = "hub") -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-") or default


def create_hub(root: str, title: str, paths: list[str], folder: str = "hubs") -> Path:
    """A Markdown hub that links existing files by relative paths; never overwrites one."""
    base, links = Path(root).resolve(), []
    for p in dict.fromkeys(paths):
        full = (base / p).resolve()
        if Path(p).is_absolute() or base not in full.parents or not full.is_file():
            raise ValueError(f"not a file inside the tree: {p}")
        links.append(full.relative_to(base).as_posix())
    if not title.strip() or not links:
        raise ValueError("a hub needs a title and a file")
    out = base / folder / f"{slug(title)}.md"
    out.parent.mkdir(parents=True, exist_ok=True)
    with out.open("x") as f:
        f.write(f"# {title.strip()}\n\n" + "".join(f"- [[{x}]]\n" for x in links))
    return out


def write_suggestions(root: str, suggestions: list[dict], folder: str = "suggested-hubs") -> list[Path]:
    """One Markdown file for each suggestion (label, rationale, paths); of equal slugs the last one stays."""
    out = {}
    for s in suggestions:
        path = Path(root) / folder / f"{slug(s['label'])}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"# {s['label']}\n\n{s.get('rationale', '')}\n\n" + "".join(f"- [[{p}]]\n" for p in s["paths"]))
        out[path] = path
    return list(out)


class RestorePoints:
    """Backups of file contents as a table partitioned by point; the newest MAX_POINTS are kept."""

    def __init__(self, store: Store) -> None:
        self.store, self.path = store, f"{store.root}/restore-points"

    def list(self) -> list[dict]:
        return (self.store._read("restore-points.json") or {"points": []})["points"]

    def create(self, spark: SparkSession, root: str, paths: list[str], message: str = "") -> str:
        """A file that does not exist yet is recorded as absent, so restoring removes it again."""
        points = self.list()
        point = f"{int(time.time() * 1000)}-{len(points)}"
        rows = [(p, (Path(root) / p).read_text() if (Path(root) / p).is_file() else None) for p in dict.fromkeys(paths)]
        spark.createDataFrame(rows, "path string, content string").write.parquet(f"{self.path}/{point}")
        points = [*points, {"id": point, "files": [p for p, _ in rows], "message": message}]
        for old in points[:-MAX_POINTS]:
            self.store._fs.delete(self.store._path(f"{self.path}/{old['id']}"), True)
        self.store._write("restore-points.json", {"points": points[-MAX_POINTS:]})
        return point

    def restore(self, spark: SparkSession, root: str, point: str) -> list[str]:
        if point not in {p["id"] for p in self.list()}:
            raise LookupError(f"no restore point {point}")
        done = []
        for r in spark.read.parquet(f"{self.path}/{point}").orderBy("path").collect():  # the files of one point
            target = Path(root) / r.path
            if r.content is None:
                target.unlink(missing_ok=True)
            else:
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(r.content)
            done.append(r.path)
        return done


def summary(query: str, hits: list[dict], hubs: list[str], related: list[str]) -> dict:
    """The deterministic research summary: what a chat provider would be asked for, from a template."""
    top = hits[0] if hits else None
    return {
        "answer": f"{top['title']} in {top['path']} fits '{query}' best." if top else f"Nothing fits '{query}'.",
        "files": list(dict.fromkeys(h["path"] for h in hits))[:5],
        "hubs": hubs[:3],
        "next": related[:3],
    }


#: What a chat provider is told before a research summary is asked for.
SUMMARY_ASK = 'Answer the question from the evidence alone, in 2 to 4 sentences that name files. Reply with one JSON object: {"answer": text, "files": [paths], "next": [paths]}.'


def asked_summary(chat: Callable[[str, str], str], query: str, hits: list[dict], hubs: list[str], related: list[str]) -> dict:
    """The research summary by a chat provider. Its reply is repaired where it can be; files that the evidence does not hold
    are dropped, and a reply without an answer raises ValueError."""
    told = summary(query, hits, hubs, related)
    known = {h["path"] for h in hits} | set(related)
    reply = repaired_json(chat(SUMMARY_ASK, json.dumps({"question": query, "hits": hits, "hubs": hubs, "related": related}, default=str)))
    answer = str(reply.get("answer") or "").strip()
    if not answer:
        raise ValueError("the summary has no answer")
    paths = lambda name: [p for p in reply.get(name) or [] if p in known]
    return told | {"answer": answer, "files": paths("files") or told["files"], "next": paths("next")}


def repaired_json(text: str) -> dict:
    """The first JSON object in a text: fences, prose around it, trailing commas and open brackets are repaired."""
    body = re.sub(r"^```\w*\s*|\s*```$", "", text.strip())
    start = body.find("{")
    if start < 0:
        raise ValueError("no JSON object")
    body = body[start:]
    try:
        return json.JSONDecoder().raw_decode(body)[0]
    except ValueError:
        pass
    open_, quoted, escaped, end = [], False, False, len(body)
    for i, c in enumerate(body):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
            if not open_:
                end = i + 1
                break
    fixed = body[:end] + '"' * quoted + "".join(reversed(open_))
    return json.loads(re.sub(r",\s*([}\]])", r"\1", fixed))


def skeleton(symbols: DataFrame, path: str) -> str:
    """Signatures of one file in order, nested by parent."""
    rows = symbols.where(F.col("path") == path).orderBy("line", "name").collect()  # one file's
    level: dict[str, int] = {}
    out = []
    for r in rows:
        level[r.name] = level.get(r.parent_name, -1) + 1 if r.parent_name else 0
        out.append("  " * level[r.name] + f"{r.signature}  :{r.line}-{r.end_line}")
    return "\n".join(out)


def doctor(store: Store, mode: str = "full") -> dict:
    """Health of an index: pointer, issues, table sizes."""
    p = store.pointer()
    m = store.manifest(p.active) if p.active else None
    issues = validate(store, p.active, mode) if p.active else [("no-generation", "there is no active generation")]
    return {"active": p.active, "pending": p.pending, "freshness": p.freshness, "reason": p.reason, "tables": m.tables if m else {}, "issues": [c for c, _ in issues], "ok": not issues}
