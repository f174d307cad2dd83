"""Chat formatting by a finite-state machine over roles and a declarative template.

`TEMPLATE` says, for each role, what stands before and after a turn's text, whether the text counts for
the loss, and which roles may follow. Rows of a conversation are read in order of turn (then role, then
text; nulls first) and come out as segments of text with a loss flag, one after the other: a task holds
one turn at a time, never a conversation. Control strings inside texts are escaped: a backslash goes
behind their first character, and each backslash is doubled, so that `unescape` gives the text back.

Nulls: a null text is empty; a null role is the empty role, which no machine accepts; rows of a null
conv_id are one conversation. Roles that the template doesn't name are formatted as `other` turns with
their name; their conversation is not valid. Repeated rows are turns of their own. An empty table gives no
conversations but those that the query adds. A very long text is one turn, held once in its task. Ids are
whole numbers, or strings of such. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subspark.llm.common import arrow_schema

#: role: (text before, text after, loss, roles that may follow; None: the end)
TEMPLATE = {
    "start": ("", "", False, ("system", "user")),
    "system": ("<<SYS>>", "</s>", False, ("user",)),
    "user": ("[INST]", "</s>", False, ("assistant", None)),
    "assistant": ("[/INST]", "</s>", True, ("user", None)),
}
#: Before and after the name of any other role.
OTHER = ("<<ROLE>>", "<</ROLE>>")
SEGMENTS = "conv_id long, turn_no long, seg_no int, kind string, text string, loss boolean, valid boolean"


class Template:
    """The markers, and how texts are escaped against them."""

    def __init__(self, roles: dict = TEMPLATE, other: tuple[str, str] = OTHER):
        self.roles = roles
        self.other = other
        self.end = roles["user"][1]
        marks = sorted({m for r in roles.values() for m in r[:2] if m} | set(other), key=len, reverse=True)
        for a in marks:
            if len(a) < 2 or "\\" in a or a[1:].startswith("\\"):
                raise ValueError(f"no control string: {a}")
            if any(a[k:] and b.startswith(a[k:]) for b in marks for k in range(1, len(a))):
                raise ValueError(f"{a} overlaps another control string")
        one = "|".join(map(re.escape, marks))
        self._inside = re.compile(f"(?s)(?=(?:{one}))(.)")
        self._mark = re.compile(one)
        self._escaped = re.compile(r"(?s)\\(\\?)")

    def escape(self, text: str) -> str:
        return self._inside.sub(r"\1\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        """(kind, text, loss) of one turn."""
        if role in self.roles and role != "start":
            before, after, loss, _ = self.roles[role]
            head = before
        else:
            head, after, loss = self.other[0] + self.escape(role) + self.other[1], self.end, False
        return [("mark", head, False), ("text", self.escape(text), loss), ("mark", after, False)]

    def follows(self, state: str, role: str | None) -> bool:
        return state in self.roles and role in self.roles[state][3] and role != "start"

    def turns(self, parts: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, str]]:
        """(role, text), read back from the formatted string, which comes in parts (with or without loss)."""
        named = {r[0]: name for name, r in self.roles.items() if r[0]}
        held, role = "", None
        for part, _ in parts:
            held += part
            while found := self._mark.search(held):
                before, mark = held[: found.start()], found.group()
                held = held[found.end() :]
                if mark in named:
                    role = named[mark]
                elif mark == self.other[0]:
                    role = None
                elif mark == self.other[1]:
                    role = self.unescape(before)
                else:
                    yield role, self.unescape(before)


def ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments in order, conversations one after the other in each partition. `valid` says whether the turns up
    to here keep the order of the machine; on a conversation's last segment (kind `end`) whether it is whole."""
    made, schema = template or Template(), arrow_schema(SEGMENTS)

    def run(batches):
        now, state, valid, no, out = "none yet", "start", True, 0, []

        def end():
            return (now, no, 0, "end", "", False, valid and made.follows(state, None))

        for batch in batches:
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if conv != now:
                    if now != "none yet":
                        out.append(end())
                    now, state, valid, no = conv, "start", True, 0
                valid = valid and made.follows(state, role)
                state = role
                out.extend((conv, no, k, kind, part, loss, valid) for k, (kind, part, loss) in enumerate(made.segments(role, text.as_py())))
                no += 1
                if len(out) >= 5000:
                    yield _record(out, schema)
                    out = []
        if now != "none yet":
            yield _record([*out, end()], schema)

    return ordered(conversations).mapInArrow(run, SEGMENTS)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation, from the formatted string alone: its turns, and the text under the loss mask.
    segments: as format_chats gives them, in its order."""
    made, schema = template or Template(), arrow_schema(DIGEST)

    def run(batches):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = 0
        parts, out = [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6)]
            for conv, kind, text, flag, valid in zip(*columns, strict=True):
                if kind != "end":
                    parts.append((text, flag))
                    chars += len(text)
                    if flag:
                        clear = made.unescape(text)
                        loss_chars += len(clear)
                        loss.update(clear.encode())
                if kind == "end" or text == made.end and kind == "mark":
                    for role, said in made.turns(iter(parts)):
                        n_turns += 1
                        turns.update(f"{role}\n{said}\n".encode())
                    parts = []
                if kind != "end":
                    continue
                out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = chars = 0
                if len(out) >= 5000:
                    yield _record(out, schema)
                    out = []
        if out:
            yield _record(out, schema)

    return segments.mapInArrow(run, DIGEST)


SAID = "</s>[INST] ok [/INST]"


def op6(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    more = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
  + coalesce((SELECT sum((length(text) - length(replace(text, m, ''))) // length(m)) FROM
    (VALUES ('</s>'), ('[INST]'), ('[/INST]'), ('<<SYS>>'), ('<<ROLE>>'), ('<</ROLE>>')) k(m)), 0)
  + CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 17 + length(role) END + 4 AS chars,
  lag(role) OVER w AS before, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE coalesce(before, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END
    AND (nth < n OR role IN ('user', 'assistant'))) AS valid
FROM e GROUP BY conv_id
"""
