"""Chat formatting by incremental black-box rendering.

A template is a function from turns to one string and nothing is known of its
inside. Rendering the prefixes of a conversation, one turn longer each, and
comparing neighbouring outputs gives each turn's span in the output; an output
that doesn't begin with the one before shows that the template rewrites history.

A turn's text inside its span is found by rendering too: with two probes in its
place, the outputs are equal up to the text and from its end on. What stands
before the text in its span is the turn's header, by which its role is known.
Headers and footers found for a role serve for its further turns, as long as what
they leave of the span, unescaped, is the turn's text; else the turn is probed in
its own place. Where history was rewritten, each turn is probed in the final
output. Loss mask and digests are cut from these places and nothing else.

All prefixes are rendered, whatever the conversation's length: n turns cost n
times the output, and two outputs are held at a time.

The bundled template marks turns and escapes control strings in texts
reversibly; a template brings the inverse of its escaping along.

Defined cases: a null text or role is the empty string; turns are ordered by
turn number (null first), then role and text, so ties and repeated rows have a
fixed order and each is a turn; null conversation ids form one conversation. A
turn whose text isn't in the final output has the place (-1, -1) and no loss.
A conversation is one document and is rendered in one task; conversations pass
through a task one after the other, from rows sorted by Spark. Other columns are
left out, whatever their names; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import bounded_batches

Turn = tuple[str, str]

#: Texts that are put in a turn's place to find it: different at either end, and nothing to escape.
PROBES = ("0", "1")
#: Blocks of the bundled template that are kept, so that longer prefixes don't escape them anew.
MAX_CACHED = 4096

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat formats, which must not stand in a text as they are.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_TAILS = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
_BLOCK = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)


def escaped(text: str) -> str:
    """A backslash goes behind the first character of each control string, escaped ones included."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


@lru_cache(MAX_CACHED)
def _block(role: str, text: str) -> str:
    return f"{START}{_role(role)}\n{escaped(text)}{END}\n"


def marked(turns: list[Turn]) -> str:
    """The bundled template: a marked block for each turn."""
    return "".join([_block(r, t) for r, t in turns])


@dataclass(frozen=True)
class Template:
    """A black box, and the inverse of what it does to a text."""

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str] = str


MARKED = Template(marked, unescaped)


def parsed(output: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the text's start and end in an output of the bundled template, for readers that have nothing else."""
    return [(_unrole(m[1]), unescaped(m[2]), m.start(2), m.end(2)) for m in _BLOCK.finditer(output)]


@dataclass
class Rendered:
    """The output; by turn, its span, its text's place and its role; and the turns at which an earlier output was rewritten."""

    output: str
    spans: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    roles: list[str]
    rewrites: list[int]


def rendered(turns: list[Turn], template: Template = MARKED) -> Rendered:
    """All prefixes rendered and compared.

    Where history is rewritten, a span begins at the first character that differs.
    """
    found = Rendered(template.render([]), [], [], [], [])
    around: dict[str, tuple[str, str]] = {}
    for k, (role, text) in enumerate(turns):
        before, out = found.output, template.render(turns[: k + 1])
        start = len(before)
        if not out.startswith(before):
            found.rewrites.append(k)
            start = _common(before, out)
        found.output = out
        found.spans.append((start, len(out)))
        if found.rewrites:
            continue
        head, tail = around.get(role, ("", ""))
        place = (start + len(head), len(out) - len(tail))
        known = role in around and out.startswith(head, start) and out.endswith(tail) and place[0] <= place[1]
        if not known or template.unescape(out[place[0] : place[1]]) != text:
            place = located(turns[: k + 1], k, out, template)
            if place[0] >= start:
                around[role] = out[start : place[0]], out[place[1] :]
        found.texts.append(place)
    if found.rewrites:
        found.texts = [located(turns, i, found.output, template) for i in range(len(turns))]
    # A header is known by the first turn that has it.
    named: dict[str, str] = {}
    for (role, _), (start, _), (a, _) in zip(turns, found.spans, found.texts, strict=True):
        found.roles.append(named.setdefault(found.output[start:a], role) if a >= start and not found.rewrites else role)
    return found


def located(turns: list[Turn], i: int, output: str, template: Template) -> tuple[int, int]:
    """Start and end of the i-th text in the output of all turns; (-1, -1) if it isn't there."""
    one, two = (template.render([*turns[:i], (turns[i][0], p), *turns[i + 1 :]]) for p in PROBES)
    if one == two:
        return -1, -1
    head, tail = _common(one, two), _common(one[::-1], two[::-1])
    if len(output) < head + tail or output[:head] != one[:head] or output[len(output) - tail :] != one[len(one) - tail :]:
        return -1, -1
    return head, len(output) - tail


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def format_chats(
    df: DataFrame, template: Template = MARKED, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv, formatted, and by turn spans and texts (start, end) and roles; rewrites (turn places). One row per conversation."""
    bounded_batches(df.sparkSession)
    rows = df.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    kind = rows.schema["conv"].dataType.simpleString()
    # The id travels as text, so that null and large ids come through pandas unchanged.
    rows = rows.withColumn("conv", F.col("conv").cast("string"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")
    names = ["conv", "formatted", "spans", "texts", "roles", "rewrites"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = ((None if pd.isna(c) else c, r, t) for pdf in batches for c, r, t in pdf.itertuples(index=False))
        out, size = [], 0
        for conv, group in groupby(turns, key=lambda x: x[0]):
            x = rendered([(r, t) for _, r, t in group], template)
            out.append((conv, x.output, [list(s) for s in x.spans], [list(s) for s in x.texts], x.roles, x.rewrites))
            size += len(x.output)
            if size > 4_000_000:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    places = "array<array<long>>"
    done = ordered.mapInPandas(run, f"conv string, formatted string, spans {places}, texts {places}, roles array<string>, rewrites array<int>")
    return done.withColumn("conv", F.col("conv").cast(kind))


def loss_digest(formatted: DataFrame, loss_role: str = "assistant", unescape: Callable[[str], str] = unescaped) -> DataFrame:
    """conv, n_turns, digests and counts, all cut from the output at the places that rendering found.

    The loss mask covers the texts of loss_role; unescape is the template's.
    """
    kind = formatted.schema["conv"].dataType.simpleString()
    rows = formatted.select(F.col("conv").cast("string").alias("conv"), "formatted", "texts", "roles", F.size("rewrites").alias("rewrites"))

    def digest(output: str, texts, roles) -> tuple[int, str, int, str, int]:
        whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
        for role, (a, b) in zip(roles, texts, strict=True):
            text = unescape(output[a:b]) if a >= 0 else ""
            whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == loss_role:
                loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(text)
        return len(roles), whole.hexdigest(), chars, loss.hexdigest(), len(output)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for pdf in batches:
            made = [digest(*x) for x in zip(pdf["formatted"], pdf["texts"], pdf["roles"], strict=True)]
            yield pd.concat([pdf[["conv"]], pd.DataFrame(made, columns=names, index=pdf.index), pdf[["rewrites"]]], axis=1)

    out = rows.mapInPandas(run, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites int")
    return out.withColumn("conv", F.col("conv").cast(kind))
