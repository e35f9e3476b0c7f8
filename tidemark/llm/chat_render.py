"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. It is not looked into: the prefixes of a
conversation are rendered one after another, and consecutive outputs are compared. What a longer prefix adds is
the new turn's span; where its output does not begin with the one before, the template rewrites history. Where a
turn's text stands inside its span is found by rendering the turn once more with a probe in place of the text.

Defined cases: a null text or role counts as empty; turns are ordered by turn, a null turn first, then by role and
text, so ties and repeated rows have a fixed order; rows of a null conv_id form one conversation; a table without
rows gives none. One conversation is the unit of work, as its output is one string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, or_empty

Turns = Sequence[tuple[str, str]]

_CONTROL = re.compile(r"<(\\*)\|im_(start|end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|im_(start|end)\|>")
#: Stands for a turn's text while its place is looked for; a private-use character that texts may hold as well.
PROBE = ""


def escape(text: str) -> str:
    """One more backslash in every control string, so that none is left as such."""
    return _CONTROL.sub(r"<\\\1|im_\2|>", text)


def unescape(text: str) -> str:
    """The inverse of `escape`."""
    return _ESCAPED.sub(r"<\1|im_\2|>", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    """The inverse of `escape_role`."""
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def marked(turns: Turns) -> str:
    """The template of this module: each turn between a start mark with its role, and an end mark."""
    return "".join(f"<|im_start|>{escape_role(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


def read_marked(output: str) -> list[tuple[str, str]]:
    """The turns that `marked` rendered."""
    turns = []
    for part in output.split("<|im_start|>")[1:]:
        role, _, text = part.removesuffix("\n").removesuffix("<|im_end|>").partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


@dataclass
class Span:
    """Where a turn and its text stand in the output; `rewritten`: rendering it changed what stood before."""

    start: int
    end: int
    text_start: int
    text_end: int
    rewritten: bool


def common_prefix(a: str, b: str) -> int:
    """How far two strings agree, by halves: each step compares slices, not single characters."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def locate_turns(template: Callable[[Turns], str], turns: Turns) -> tuple[str, list[Span]]:
    """The output for all turns, and each turn's span in it, from renderings of successive prefixes."""
    before, spans = template([]), []
    for k, (role, text) in enumerate(turns):
        head = list(turns[:k])
        now = template([*head, (role, text)])
        rewritten = not now.startswith(before)
        start = len(before)
        if rewritten:  # all that is certain: up to here the two outputs agree
            start = common_prefix(now, before)
        probed = template([*head, (role, PROBE)])
        # the probe is the first one after what was there: the role that comes before it is rendered alike with an empty text
        empty = template([*head, (role, "")])
        at = common_prefix(probed, empty)
        spans.append(Span(start, len(now), at, at + len(now) - len(empty), rewritten))
        before = now
    return before, spans


def format_conversations(
    conversations: DataFrame,
    template: Callable[[Turns], str] = marked,
    reader: Callable[[str], list[tuple[str, str]]] = read_marked,
    restore: Callable[[str], str] = unescape,
    learned_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: `conv_id, formatted, turns` read back, and the text under the loss mask.

    Columns: `conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, formatted, rewrites_history`.
    """
    rows = conversations.select("conv_id", F.struct("turn", or_empty("role").alias("role"), or_empty("text").alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for conv_ids, conversations_ in batches:
            out: dict[str, list] = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted", "rewrites_history")}
            for turns in conversations_:
                output, spans = locate_turns(template, [(t["role"], t["text"]) for t in turns])
                back = reader(output)
                learned = "".join(restore(output[s.text_start : s.text_end]) for s, (role, _) in zip(spans, back, strict=True) if role == learned_role)
                digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in back).encode("utf-8", "surrogatepass"))
                row = (
                    len(back), digest.hexdigest(), len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(),
                    len(output), output, any(s.rewritten for s in spans),
                )
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            yield {"conv_id": conv_ids, **out}

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, rewrites_history boolean"
    return map_arrow(grouped, ["conv_id", "turns"], work, schema)
