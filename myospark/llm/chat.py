"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them, in order, into one string: texts are escaped,
and other parts become placeholders, whose references and expanded numbers of tokens are recorded. A turn's string is marked by the template,
and everything in it that the mask names is trained on: the texts of the assistant, without placeholders.

Escaping: the mark ESCAPE stands doubled for itself, and single behind the first character of each control string, also of
overlapping ones. So no control string occurs but where the template put it, and `unescape` gives back every text.

Turns are formatted where they are; then they are shuffled by conversation and sorted, and streamed: a task holds one turn at a time,
however long its conversation is. A digest of a whole conversation can only be computed in order, so its turns meet in one task.

Turns are ordered by `turn` (nulls first), and ties by role and content; repeated rows are turns of their own. A null role or
text is an empty one, a null conv_id a conversation, a null list of parts an empty turn; a part of no kind is text, one of an unknown kind a file. Texts of any length
are formatted whole. An empty table has no conversations. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from myospark.session import ensure_workers

#: The template: what stands before a role, before a turn's content, and after it.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: Control strings of this template and of others, escaped in texts and roles. Those of the form <|name|> begin with the first.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "⁠"
#: An image has a token for each square of PATCH pixels, audio AUDIO_RATE tokens a second, documents PAGE_TOKENS a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024
TRAINED = "assistant"

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,ref:string,at:int,tokens:long>"
FORMATTED = f"conv_id long, turn long, role string, formatted string, mask array<struct<start:int,end:int>>, attachments array<{ATTACHMENT}>, text_tokens long, tokens long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_tokens long"

_control = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ").", re.DOTALL)
_escaped = re.compile(f"{ESCAPE}(.)", re.DOTALL)
_placeholder = re.compile(r"<\|(?:image|audio|document|file)\|>")
_turn = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*){re.escape(END)}", re.DOTALL)
_token = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE + ESCAPE))


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


@dataclass
class Flatten:
    """Visits the parts of a turn; `mask` has (start, end) of each text and `attachments` (kind, ref, place, tokens) of each other part, in code points."""

    out: list[str] = field(default_factory=list)
    at: int = 0
    mask: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[str, str | None, int, int]] = field(default_factory=list)
    text_tokens: int = 0

    def put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_file)(part)

    def visit_text(self, part: dict) -> None:
        text, start = part["text"] or "", self.at
        self.put(escape(text))
        self.text_tokens += len(_token.findall(text))
        if text:
            self.mask.append((start, self.at))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((kind, part["ref"], self.at, tokens))
        self.put(f"<|{kind}|>")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, max(1, math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH)))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, math.ceil((part["seconds"] or 0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, (part["pages"] or 0) * PAGE_TOKENS))

    def visit_file(self, part: dict) -> None:
        self.attach("file", part, 1)


def format_turn(role: str, parts: list[dict | None]) -> tuple[str, list[dict], list[dict], int, int]:
    """(formatted, mask, attachments, tokens of texts, tokens of all) of one turn."""
    f = Flatten()
    f.put(TURN + escape(role) + SAYS)
    for part in parts:
        if part is not None:
            f.visit(part)
    f.put(END)
    mask = [{"start": a, "end": b} for a, b in f.mask] if role == TRAINED else []
    found = [dict(zip(("kind", "ref", "at", "tokens"), x, strict=True)) for x in f.attachments]
    return "".join(f.out), mask, found, f.text_tokens, f.text_tokens + sum(x[3] for x in f.attachments)


def typed(kind: str, **values: Column) -> Column:
    """A part with these fields; the others are null. For lists of parts: F.array(typed("text", text=...), typed("image", ref=...))."""
    fields = [x.split(":") for x in PART[len("struct<") : -1].split(",")]
    given = {"kind": F.lit(kind), **values}
    return F.struct(*(given.get(name, F.lit(None)).cast(of).alias(name) for name, of in fields))


def format_turns(turns: DataFrame, content: str = "content") -> DataFrame:
    """(FORMATTED) of rows conv_id, turn, role and a list of parts (PART). Narrow: no shuffle."""
    ensure_workers(turns.sparkSession)
    kinds = {
        "mask": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
        "attachments": pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())])),
    }
    names = ["formatted", "mask", "attachments", "text_tokens", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [format_turn(role, parts or []) for role, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            made = [pa.array([r[i] for r in rows], kinds.get(c, pa.string() if c == "formatted" else pa.int64())) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], ["conv_id", "turn", "role", *names])

    role = F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, content).mapInArrow(run, FORMATTED)


def read_turn(formatted: str) -> tuple[str, list[str]]:
    """Role and texts of a formatted turn."""
    m = _turn.fullmatch(formatted)
    if m is None:
        raise ValueError(f"this isn't a formatted turn: {formatted[:60]!r}")
    return unescape(m[1]), [unescape(x) for x in _placeholder.split(m[2])]


def in_order(formatted: DataFrame) -> DataFrame:
    """The turns of each conversation together and in order. One shuffle, of formatted turns."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")


def place_turns(formatted: DataFrame) -> DataFrame:
    """formatted turns with `start`, where each begins in the string of its whole conversation, and with masks and attachments placed there too.

    Strings of whole conversations are never built; whoever wants one joins a conversation's turns in order. The running sum streams.
    """
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "formatted").rowsBetween(Window.unboundedPreceding, -1)
    rows = formatted.withColumn("start", F.coalesce(F.sum(F.length("formatted").cast("long")).over(before), F.lit(0)))
    at = F.col("start")
    mask = F.transform("mask", lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end")))
    attachments = F.transform("attachments", lambda a: F.struct(a["kind"].alias("kind"), a["ref"].alias("ref"), (a["at"] + at).alias("at"), a["tokens"].alias("tokens")))
    return rows.withColumns({"mask": mask, "attachments": attachments})


def read_back(formatted: DataFrame) -> DataFrame:
    """(READ) of each conversation, taken from the formatted turns and their masks alone."""

    class Conversation:
        def __init__(self, conv_id: int | None):
            self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
            self.n = self.loss_chars = self.chars = self.attached = self.tokens = 0

        def add(self, formatted: str, mask: list[dict], attachments: list[dict], tokens: int) -> None:
            role, texts = read_turn(formatted)
            self.turns.update(f"{role}\n{''.join(texts)}\n".encode())
            for span in mask:
                trained = unescape(formatted[span["start"] : span["end"]])
                self.loss.update(trained.encode())
                self.loss_chars += len(trained)
            self.n += 1
            self.chars += len(formatted)
            self.attached += len(attachments)
            self.tokens += tokens

        @property
        def row(self) -> tuple:
            return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attached, self.tokens

    types = [(c.split()[0], pa.string() if c.endswith(" string") else pa.int64()) for c in READ.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], [name for name, _ in types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            for conv_id, *turn in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row)
                    now = Conversation(conv_id)
                now.add(*turn)
            yield batch(done)
            done = []
        if now is not None:
            yield batch([now.row])

    return in_order(formatted).select("conv_id", "formatted", "mask", "attachments", "tokens").mapInArrow(run, READ)


def chat_report(conversations: DataFrame) -> DataFrame:
    """All conversations and one more, number -1, whose texts are control strings; a turn's text is its only part."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    control = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.createDataFrame([(-1, 0, "user", control), (-1, 1, TRAINED, control)], rows.schema)
    parts = F.array(typed("text", text=F.col("text")))
    return read_back(format_turns(rows.union(more).select("conv_id", "turn", "role", parts.alias("content"))))


#: The formatted length by the same replacements, one control string after another: none of them overlap in ways that matter to a length.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sizes AS (
  SELECT *, list_sum(list_transform([role, text], lambda x: length(x) + length(regexp_replace(x, '[^\x{2060}]', '', 'g'))
    + list_sum(list_transform(['<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'], lambda c: (length(x) - length(replace(x, c, ''))) // length(c))))) + 24 AS size,
    len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) AS tokens
  FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, sum(tokens)::BIGINT AS n_tokens
FROM sizes GROUP BY conv_id
"""
