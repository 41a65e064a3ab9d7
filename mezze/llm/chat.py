"""Chat formatting with schema fingerprinting.

A record's nested field paths are hashed; the hash selects a declarative mapping that says where in the record the turns
are. Records of one shape share a hash, so a mapping is looked for once per shape and worker. Canonical turns are then
written with a template whose control strings cannot occur inside texts, as `<`, `>` and the backslash are escaped there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezze.llm.common import map_pandas

#: Each layout: paths a record must have, those it may have, and its turns: (role, path) or (list, role path, text path).
LAYOUTS = {
    "prompt": {"must": {"prompt", "response"}, "may": {"system"}, "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "instruction": {"must": {"instruction", "output"}, "may": {"system", "input"}, "turns": [("system", "system"), ("user", ("instruction", "input")), ("assistant", "output")]},
    "messages": {"must": {"messages[].role", "messages[].content"}, "may": set(), "list": ("messages", "role", "content")},
    "message_parts": {"must": {"messages[].role", "messages[].content[].text"}, "may": set(), "list": ("messages", "role", "content")},
    "from_value": {"must": {"conversations[].from", "conversations[].value"}, "may": {"system"}, "list": ("conversations", "from", "value")},
}
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant"}
TURN = "struct<role:string,text:string>"
#: Shapes that a task remembers.
SHAPES = 100_000
_LONE = re.compile("[\ud800-\udfff]")
#: A field's name, or None for the members of a list.
Path = tuple[str | None, ...]


def steps(path: str) -> Path:
    """A layout's path as steps: `messages[].role` is the role within each member of messages."""
    return tuple(x for name in path.split(".") for x in ([name.removesuffix("[]"), None] if name.endswith("[]") else [name]))


def paths(value) -> set[Path]:
    """Nested field paths of a record, as steps; the members of a list share one path."""
    found: set[Path] = set()
    todo: list[tuple[Path, object]] = [((), value)]
    while todo:
        at, value = todo.pop()
        inner = value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ()
        if value and isinstance(value, (dict, list)):
            todo.extend(((*at, k), v) for k, v in inner)
        else:
            found.add((*at, None) if isinstance(value, list) else at)
    return found


def _digest(have: set[Path]) -> str:
    return hashlib.blake2b("\n".join(sorted(map(json.dumps, have))).encode(), digest_size=16).hexdigest()


def fingerprint(record) -> str:
    """Hash of a record's paths, in hexadecimal digits; values and the order of fields do not matter."""
    return _digest(paths(record))


def _clean(text: str) -> str:
    """The text with a replacement character for each lone surrogate, which no UTF-8 text can hold."""
    return _LONE.sub("\ufffd", text)


def _text(value) -> str:
    """A text as it is, null as an empty one, the texts of a list of parts line by line, anything else as JSON."""
    if isinstance(value, list):
        return "\n".join(_text(x["text"]) if isinstance(x, dict) and isinstance(x.get("text"), str) else _text(x) for x in value)
    return _clean(value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False))


class Mapper:
    """Chooses the layout of a record's fingerprint: a caller's choice, else that with the most required paths present, first in order on a tie."""

    def __init__(self, layouts: dict = LAYOUTS, chosen: dict[str, str | None] | None = None):
        self.layouts, self.chosen = layouts, chosen or {}
        self.must = {name: set(map(steps, x["must"])) for name, x in layouts.items()}
        self.seen: dict[str, str | None] = {}

    def choose(self, record) -> tuple[str, str | None]:
        """The record's fingerprint and its layout's name; a chosen layout holds only where its list is one."""
        have = paths(record)
        key = _digest(have)
        if key not in self.seen:
            if len(self.seen) >= SHAPES:
                self.seen.clear()
            empty = lambda x: "list" in x and (x["list"][0], None) in have
            fits = [name for name, x in self.layouts.items() if self.must[name] <= have or empty(x)]
            self.seen[key] = self.chosen.get(key, max(fits, key=lambda n: len(self.must[n]), default=None))
        return key, self.seen[key]

    def turns_of(self, record) -> tuple[str, str | None, list[tuple[str, str]]]:
        """Fingerprint, layout and turns of a parsed record."""
        key, name = self.choose(record)
        if name is None or not isinstance(record, dict):
            return key, None, []
        layout, out = self.layouts[name], []
        if "list" in layout:
            of, role, content = layout["list"]
            if "system" in layout["may"] and record.get("system"):
                out.append(("system", _text(record["system"])))
            for x in record.get(of) or ():
                if isinstance(x, dict):
                    said = _text(x.get(role))
                    out.append((ROLES.get(said, said) if role == "from" else said, _text(x.get(content))))
            return key, name, out
        must = self.must[name]
        for role, where in layout["turns"]:
            if isinstance(where, tuple):
                out.append((role, "\n\n".join(t for t in (_text(record.get(w)) for w in where) if t)))
            elif where in record or (where,) in must:
                out.append((role, _text(record.get(where))))
        return key, name, out


def canonical_turns(records: DataFrame, layouts: dict = LAYOUTS, chosen: dict[str, str] | None = None) -> DataFrame:
    """conv_id, layout, turns (array of role, text), fingerprint of rows with conv_id and record (JSON).

    `layouts` may hold further mappings; `chosen` names the layout of a fingerprint outright. A record that is null, not
    JSON, nested deeper than Python reads or of an unknown layout has a null layout and no turns, the last with its
    fingerprint, which `shapes` counts. A null text is an empty one; lone surrogates become U+FFFD; a content given as a
    list of parts is their texts line by line, other parts as JSON. Further fields neither help nor hinder, and further
    columns are left out. One row per input row, repeated rows alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = Mapper(layouts, chosen)
        for batch in batches:
            found = []
            for record in batch["record"]:
                try:
                    found.append(mapper.turns_of(json.loads(record)))
                except (TypeError, ValueError, RecursionError):
                    found.append((None, None, []))
            turns = [[{"role": r, "text": t} for r, t in x] for _, _, x in found]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "layout": [n for _, n, _ in found], "turns": turns, "fingerprint": [k for k, _, _ in found]})

    return map_pandas(records.select("conv_id", "record"), "conv_id", run, f"conv_id long, layout string, turns array<{TURN}>, fingerprint string")


def shapes(canonical: DataFrame) -> DataFrame:
    """fingerprint, layout, n: how many records have each shape. A null fingerprint stands for what is not JSON."""
    return canonical.groupBy("fingerprint", "layout").agg(F.count("*").alias("n"))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")


def write(turns) -> tuple[str, list[dict[str, int]]]:
    """The template around each turn, and the spans of assistant texts in it."""
    out, spans, at = [], [], 0
    for turn in turns:
        head, body = f"<turn {escape(turn['role'])}>\n", escape(turn["text"])
        begins, ends = at + len(head), at + len(head) + len(body)
        if turn["role"] == "assistant":
            spans.append({"start": begins, "end": ends})
        out += (head, body, "</turn>\n")
        at = ends + len("</turn>\n")
    return "".join(out), spans


def format_turns(canonical: DataFrame) -> DataFrame:
    """conv_id, layout, formatted, loss_spans: the template around each turn, and where assistant texts stand in it.

    A turn is `<turn ROLE>`, a line end, the escaped text, `</turn>` and a line end. Spans are [start, end) in code points.
    No turns give an empty text. One row per input row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            written = [write(turns) for turns in batch["turns"]]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "layout": batch["layout"], "formatted": [w for w, _ in written], "loss_spans": [x for _, x in written]})

    return map_pandas(canonical.select("conv_id", "layout", "turns"), "conv_id", run, "conv_id long, layout string, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "g": ">"}.get(m[1], m[1]), text, flags=re.S) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns back from the template; neither a role nor a text holds a bare < or >."""
    out, at = [], 0
    while at < len(formatted):
        close = formatted.index(">\n", at)
        end = formatted.index("</turn>\n", close)
        out.append((_plain(formatted[at + 6 : close]), _plain(formatted[close + 2 : end])))
        at = end + 8
    return out


def read_formatted(written: DataFrame) -> DataFrame:
    """conv_id, turns, loss_texts: what formatted and loss_spans say, unescaped. A null conversation id stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turns = [[{"role": r, "text": t} for r, t in parse(f)] for f in batch["formatted"]]
            loss = [[_plain(f[s["start"] : s["end"]]) for s in spans] for f, spans in zip(batch["formatted"], batch["loss_spans"])]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "turns": turns, "loss_texts": loss, "formatted_chars": [len(f) for f in batch["formatted"]]})

    return map_pandas(written.select("conv_id", "formatted", "loss_spans"), "conv_id", run, f"conv_id long, turns array<{TURN}>, loss_texts array<string>, formatted_chars long")


def records_of(turns: DataFrame) -> DataFrame:
    """conv_id, record: each conversation's rows (conv_id, turn, role, text) as one JSON record, in several layouts.

    A user's question with its answer becomes prompt and response, after a system turn too; others become messages, or
    from and value where the id is odd and no role has a name of its own. Rows go by turn, then role and text, nulls first;
    a null role or text is an empty one. Rows without a conv_id are one conversation. A conversation is one row, so
    it should fit in a task's memory.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    are = lambda *names: roles == F.array(*map(F.lit, names))
    value = lambda i: F.col("t")[i]["text"]
    usual = F.forall("t", lambda x: x["role"].isin("system", "user", "assistant"))
    named = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    record = (
        F.when(are("user", "assistant"), F.to_json(F.struct(value(0).alias("prompt"), value(1).alias("response"))))
        .when(are("system", "user", "assistant"), F.to_json(F.struct(value(0).alias("system"), value(1).alias("instruction"), value(2).alias("output"))))
        .when(usual & (F.pmod("conv_id", F.lit(2)) == 1), F.to_json(F.struct(named.alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    return t.select("conv_id", record.alias("record"))
