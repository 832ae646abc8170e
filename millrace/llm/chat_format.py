"""Conversations with typed content parts as one text each, with their attachments and token counts.

The content of a message is plain text or a JSON list of parts, each an object with a `type`:

    {"type": "text", "text": ...}
    {"type": "image", "url": ..., "width": ..., "height": ...}
    {"type": "audio", "url": ..., "seconds": ...}
    {"type": "document", "url": ..., "pages": ...}      or with "parts": a list of parts, in any depth

A visitor walks the parts in order. Text is kept; every attachment becomes a placeholder <|image|>, <|audio|> or
<|document|>, and its reference is recorded with kind, address, place and the number of tokens that the placeholder
expands to. A document with parts of its own is its placeholder followed by what its parts give. Text that looks like a marker is escaped
(unescape() gives it back), so that no message can forge a role or an attachment.

Tokens: text by the greedy word-piece automaton; an image 16 for each tile of 224 x 224 pixels; audio 25 a second; a
document 256 a page; and one for each role marker, end marker and attachment frame. Sizes that are missing, not numbers or not positive count as one tile,
second or page.

Cases: a row with a null conversation id is a conversation of its own, with a null id. Messages are ordered by turn (null first), then by role and
content; repeated rows are kept. A null role is `unknown`. A null content is an empty text. A content that isn't a list of objects
is plain text. A part of another type, or a text part without text, is an empty text. An empty table gives an
empty result. Further columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, lean, table
from .token_counts import VOCABULARY, Counter, build_automaton, read_vocabulary

TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 224, 16, 25, 256
_ATTACHMENT = pa.struct([("number", pa.int32()), ("message", pa.int32()), ("kind", pa.string()), ("url", pa.string()), ("place", pa.int32()), ("n_tokens", pa.int64())])


def escape(text: str) -> str:
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return text.replace("<\\|", "<|").replace("<\\\\", "<\\")


def amount(value: Any) -> float:
    """A positive finite number, else 1."""
    if isinstance(value, bool) or not isinstance(value, int | float):
        return 1.0
    return float(value) if 0 < value < 1e12 else 1.0


def parts_of(content: str | None) -> list[dict] | None:
    """The typed parts of a content; None if it is plain text."""
    if content is None or not content.lstrip()[:1] == "[":
        return None
    try:
        found = json.loads(content)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, list) and found and all(isinstance(x, dict) for x in found) else None


class Flatten:
    """Visits the parts of one conversation. pieces: the text so far; spoken: the texts whose tokens are counted."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.spoken: list[str] = []
        self.attachments: list[dict] = []
        self.length = self.message = self.frames = 0

    def emit(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def visit(self, part: dict) -> None:
        # a stack of its own: depth is bounded by nothing but the content
        stack = [part]
        while stack:
            one = stack.pop()
            handler = getattr(self, f"visit_{one.get('type')}", None) if one.get("type") in ("text", "image", "audio", "document") else None
            inner = handler(one) if handler else None
            stack.extend(x for x in reversed(inner or []) if isinstance(x, dict))

    def visit_text(self, part: dict) -> None:
        if isinstance(text := part.get("text"), str):
            self.spoken.append(text)
            self.emit(escape(text))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        url = part.get("url")
        self.attachments.append({"number": len(self.attachments), "message": self.message, "kind": kind, "url": url if isinstance(url, str) else None, "place": self.length, "n_tokens": tokens})
        self.frames += 1
        self.emit(f"<|{kind}|>")

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil(amount(part.get("width")) / TILE) * math.ceil(amount(part.get("height")) / TILE)
        self.attach("image", part, TILE_TOKENS * tiles)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil(SECOND_TOKENS * amount(part.get("seconds"))))

    def visit_document(self, part: dict) -> list | None:
        inner = part.get("parts")
        has = isinstance(inner, list)
        self.attach("document", part, 0 if has else math.ceil(PAGE_TOKENS * amount(part.get("pages"))))
        return inner if has else None


def typed(role: str | None, content: str) -> Flatten | None:
    """A message whose content is a list of parts; None if it is plain text after all."""
    if (parts := parts_of(content)) is None:
        return None
    out = Flatten()
    out.emit(f"<|{escape(role if role is not None else 'unknown')}|>\n")
    for part in parts:
        out.visit(part)
    out.emit("<|end|>\n")
    return out


def escaped(column: pa.Array) -> pa.Array:
    """escape() of a whole column."""
    return pc.replace_substring(pc.replace_substring(column, "<\\", "<\\\\"), "<|", "<\\|")


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each conversation. The vocabulary is read by the driver.

    Messages are put in order as they are, so that each content is moved once. Then they are made, plain ones a column at a time, only typed ones
    by the visitor, and a conversation's are joined as they come. A conversation may span any number of batches."""
    automaton = build_automaton(read_vocabulary(vocabulary))
    kind = df.schema[conv].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held = Counter(automaton), []
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.flatnonzero(batch.column(3).to_numpy() == 0)
            messages = _messages(batch, count)
            if not len(first):
                held.append(messages)
                continue
            a, b = int(first[0]), int(first[-1])
            if held:
                yield joined([*held, messages.slice(0, a)])
            if a < b:
                yield joined([messages.slice(a, b - a)])
            held = [messages.slice(b)]
        if held:
            yield joined(held)

    rows = df.select(col(conv).alias("id"), col(turn).alias("turn"), col(role).cast("string").alias("role"), col(content).cast("string").alias("content"))
    # a message without a conversation is one of its own
    rows = rows.withColumn("alone", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    order = Window.partitionBy("id", "alone").orderBy("turn", "role", "content")
    ordered = rows.withColumn("k", (F.row_number().over(order) - 1).cast("int")).select("id", "role", "content", "k")
    attachment = "struct<number:int,message:int,kind:string,url:string,place:int,n_tokens:long>"
    return ordered.mapInArrow(lean(made), f"conv_id {kind}, prompt string, n_messages int, n_text_tokens long, n_tokens long, attachments array<{attachment}>")


def _messages(batch: pa.RecordBatch, count: Counter) -> pa.RecordBatch:
    """Rows (id, role, content, k) to what each message gives to its conversation: id, k, piece, n, more, attached."""
    roles, text = batch.column(1), pc.fill_null(batch.column(2), "")
    maybe = np.flatnonzero(np.asarray(pc.equal(pc.utf8_slice_codeunits(pc.utf8_ltrim_whitespace(text), 0, 1), "[")))
    visited = {k: v for k, r, c in zip(maybe.tolist(), roles.take(pa.array(maybe)).to_pylist(), text.take(pa.array(maybe)).to_pylist()) if (v := typed(r, c))}
    piece = pc.binary_join_element_wise("<|", escaped(pc.fill_null(roles, "unknown")), "|>\n", escaped(text), "<|end|>\n", "")
    n = count(text)[0]
    more, attached = np.full(batch.num_rows, 2, np.int64), [[]] * batch.num_rows
    if visited:
        at = np.array(list(visited))
        mask = np.zeros(batch.num_rows, bool)
        mask[at] = True
        piece = pc.replace_with_mask(piece, pa.array(mask), pa.array(["".join(v.pieces) for v in visited.values()], pa.string()))
        ends = np.cumsum([0, *(len(v.spoken) for v in visited.values())])
        sums = np.concatenate(([0], np.cumsum(count(pa.array([t for v in visited.values() for t in v.spoken], pa.large_string()))[0])))
        n[at] = sums[ends[1:]] - sums[ends[:-1]]
        for k, v in visited.items():
            attached[k] = v.attachments
            more[k] = 2 + v.frames + sum(a["n_tokens"] for a in v.attachments)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), piece, pa.array(n), pa.array(more), pa.array(attached, pa.list_(_ATTACHMENT))], names=["id", "k", "piece", "n", "more", "attached"])


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Whole conversations, whose messages follow each other and are numbered from 0, to a row each."""
    ids, k, piece, n, more, attached = (pa.concat_arrays(x) if len(x) > 1 else x[0] for x in zip(*(p.columns for p in parts)))
    k, n, more = k.to_numpy(), n.to_numpy(), more.to_numpy()
    first = np.flatnonzero(k == 0)
    bounds = np.append(first, len(k))
    prompt = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), piece), "")
    # where a message begins in its conversation, in characters
    length = np.concatenate(([0], np.cumsum(pc.utf8_length(piece).to_numpy(), dtype=np.int64)))
    before = length[:-1] - np.repeat(length[first], np.diff(bounds))
    found = pc.list_value_length(attached).to_numpy()
    at = np.repeat(np.arange(len(k)), found)
    _, _, kinds, urls, places, tokens = attached.flatten().flatten()
    ends = np.concatenate(([0], np.cumsum(found)))[bounds]
    number = np.arange(len(at)) - np.repeat(ends[:-1], np.diff(ends))
    every = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), pa.array(k[at]), kinds, urls, pa.array((places.to_numpy() + before[at]).astype(np.int32)), tokens], fields=list(_ATTACHMENT))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), every)
    spoken = np.add.reduceat(n, first)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), prompt, pa.array(np.diff(bounds).astype(np.int32)), pa.array(spoken), pa.array(spoken + np.add.reduceat(more, first)), lists], names=["conv_id", "prompt", "n_messages", "n_text_tokens", "n_tokens", "attachments"])


def page_conversations(pages: DataFrame, first: int = 1 << 40) -> DataFrame:
    """Two turns about every page, as typed parts: a question with the page as a document, which has its visible text and its pictures inside, and its audio, and a plain answer.

    Conversations are numbered from `first` on; a page without a number gives none a number."""
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " "))
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    address = F.col("url")
    none = F.lit(None)

    def part(kind: str, **more: Column) -> Column:
        fields = {"type": F.lit(kind), "text": none.cast("string"), "url": none.cast("string"), "width": none.cast("int"), "height": none.cast("int"), "seconds": none.cast("double"), "pages": none.cast("int")} | more
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    image = part("image", url=F.concat(address, F.lit("/image.png")), width=(F.length("html") % 2000).cast("int"), height=F.lit(300))
    inner = F.array(part("text", text=text), image)
    whole = F.struct(*[x.alias(k) for k, x in {"type": F.lit("document"), "text": none.cast("string"), "url": address, "seconds": none.cast("double"), "parts": inner}.items()])
    plain = F.struct(*[x.alias(k) for k, x in {"type": F.lit("text"), "text": title, "url": none.cast("string"), "seconds": none.cast("double"), "parts": F.filter(inner, lambda x: F.lit(False))}.items()])
    sound = F.struct(*[x.alias(k) for k, x in {"type": F.lit("audio"), "text": none.cast("string"), "url": F.concat(address, F.lit("/read.mp3")), "seconds": (F.length("html") / 15.0), "parts": F.filter(inner, lambda x: F.lit(False))}.items()])
    asked = F.to_json(F.array(plain, whole, sound))
    turns = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), asked.alias("text")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), title.alias("text"))))
    return pages.select((F.col("page_id") + first).alias("conv_id"), turns.alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one with typed parts about every page, as one text with its token counts and attachments."""
    plain = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_chat(plain.unionByName(page_conversations(table(spark, sf_dir, "pages"))))
