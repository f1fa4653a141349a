"""Chat formatting with a black-box template, rendered turn by turn.

A template is any function from messages to one string. The prefixes of a conversation are rendered one after the other, and each
output is compared with the one before: what is added is the new turn's span. Two more renderings, with different marks in place of the
turn's text, show where the text sits inside that span. If an output doesn't begin with the one before, the template has rewritten
history there: the conversation is flagged and has no spans. Only the last output is held, but n prefixes of a black box are work of
the order of n squared.

A template may be declared local (local()): what a turn adds depends on that turn and the one before it, as in the built-in
template. Then a long conversation is rendered in blocks of BLOCK turns that overlap by one: within a block every prefix is rendered
and compared, as above, and the work is linear. The blocks together must equal one rendering of the whole conversation; if they don't, the
declaration was wrong, and all prefixes are rendered. Conversations of up to BLOCK turns are rendered by all prefixes in any case.

Turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own. A null text or role counts as
empty. Empty tables give no conversations. Other columns of the turns are not read, whatever their names. Texts of any length are one
turn. One conversation is one row and is held by one task, as its output is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

#: Strings that mark turns in this template or in well-known others.
CONTROLS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<start_of_turn>", "<end_of_turn>")
#: Turns of a block of a long conversation, for local templates.
BLOCK = 64
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|turn\|>((?:\\.|[^\\\n])*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """A backslash after the first character of a control string breaks it; a backslash is doubled."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(messages: list[Message]) -> str:
    """<|turn|>role, a line break, text, <|end|>, a line break, for every turn. The text comes escaped; the role is escaped here."""
    return "".join("<|turn|>" + escape(role).replace("\n", "\\\n") + f"\n{text}<|end|>\n" for role, text in messages)


turn_template.local = True


def parse(formatted: str) -> list[Message]:
    """The turns that turn_template() has rendered, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _added(render: Template, history: list[Message], turn: Message, before: str) -> tuple[int, str, int, int] | None:
    """What turn adds to `before`, the rendering of history: the offset, the new part, and where the text begins and ends in it."""
    after = render([*history, turn])
    if not after.startswith(before):
        return None
    one, two = (render([*history, (turn[0], mark)]) for mark in ("\ue000", "\ue001"))
    if not one.startswith(before):
        return None
    begin = next((i for i in range(len(before), min(len(one), len(two))) if one[i] != two[i]), None)
    if begin is None or not after.startswith(turn[1], begin):
        return len(before), after[len(before) :], -1, -1
    return len(before), after[len(before) :], begin - len(before), begin - len(before) + len(turn[1])


def local(render: Template) -> Template:
    """Declare that what a turn adds depends on that turn and the one before it."""
    render.local = True
    return render


def _prefixes(messages: list[Message], render: Template, known: int = 0) -> tuple[str, list[tuple[int, int, int, int]]] | None:
    """(the last output, the span of each turn after the first `known` ones) from all prefixes; None if one rewrites the one before."""
    before, found = render(messages[:known]), []
    for i in range(known, len(messages)):
        got = _added(render, messages[:i], messages[i], before)
        if got is None:
            return None
        at, part, a, b = got
        found.append((at, at + len(part), at + a if a >= 0 else -1, at + b if a >= 0 else -1))
        before += part
    return before, found


def spans(messages: list[Message], render: Template = turn_template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(rendering, [(start, end, text start, text end) of each turn], whether history was rewritten).

    Texts are as they are given to the template. A span of -1 wasn't found.
    """
    if getattr(render, "local", False) and len(messages) > BLOCK:
        whole, out, found = render(messages), [], []
        for at in range(0, len(messages), BLOCK):
            known = min(at, 1)
            got = _prefixes(messages[at - known : at + BLOCK], render, known)
            if got is None:
                break
            text, own = got
            # A block's places count from its first turn; what stands before is what the blocks before have added.
            base = len(render(messages[at - known : at]))
            shift = sum(map(len, out)) - base
            out.append(text[base:] if at else text)
            found += [tuple(x + shift if x >= 0 else x for x in s) for s in own] if at else own
        if len(found) == len(messages) and "".join(out) == whole:
            return whole, found, False
    got = _prefixes(messages, render)
    if got is None:
        return render(messages), [(-1, -1, -1, -1)] * len(messages), True
    return *got, False


FORMATTED = T.StructType(
    [
        T.StructField("formatted", T.StringType(), False),
        T.StructField("turn_spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "end", "text_start", "text_end")] + [T.StructField("loss", T.BooleanType(), False)]), False), False),
        T.StructField("rewrites_history", T.BooleanType(), False),
    ]
)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", render: Template = turn_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv, formatted, turn_spans (code points; loss marks turns whose text is trained on), rewrites_history."""
    turns = df.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("__turns"))
    schema = T.StructType([turns.schema[conv], *FORMATTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for given in part.column(1).to_pylist():
                    messages = [(x["role"] or "", escape(x["text"] or "")) for x in given]
                    whole, found, rewritten = spans(messages, render)
                    rows.append((whole, [dict(zip(("start", "end", "text_start", "text_end"), s, strict=True), loss=m[0] in loss_roles) for s, m in zip(found, messages, strict=True)], rewritten))
                cols = [part.column(0), *(pa.array([r[k] for r in rows], out.field(k + 1).type) for k in range(3))]
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    return turns.mapInArrow(run, schema)


READ = T.StructType([T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType(), False), T.StructField("text", T.StringType(), False)]), False), False), T.StructField("loss_text", T.StringType(), False)])


def read_back(df: DataFrame, conv: str = "conv_id", read: Callable[[str], list[Message]] = parse) -> DataFrame:
    """From format_conversations()'s rows: conv, formatted, turns as parsed from the output, loss_text as cut out under the mask, both unescaped."""
    source = df.select(conv, "formatted", F.transform(F.filter("turn_spans", lambda s: s["loss"] & (s["text_start"] >= 0)), lambda s: F.struct(s["text_start"].alias("a"), s["text_end"].alias("b"))).alias("__loss"))
    schema = T.StructType([source.schema[conv], source.schema["formatted"], *READ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, masks = part.column(1).to_pylist(), part.column(2).to_pylist()
                turns = [[{"role": a, "text": b} for a, b in read(t)] for t in texts]
                loss = ["".join(unescape(t[s["a"] : s["b"]]) for s in m) for t, m in zip(texts, masks, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(turns, out.field(2).type), pa.array(loss, out.field(3).type)], schema=out)

    return source.mapInArrow(run, schema)
