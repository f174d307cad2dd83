import hashlib
import random
from collections import defaultdict

import pytest

from subspark.llm import chat_format as C


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = ["hi", "", None, "\\", "\\\\<", "</s>", "<\\/s>", "[INST][INST]", "[/INST", "<<SYS>>\n</s", C.SAID, "é [/INST]\\</s>", "x" * 50_000]


def chats():
    rng = random.Random(1)
    rows = []
    for conv in range(60):
        roles = ["user", "assistant"] * 4 if conv % 2 else ["system", "user", "assistant"]
        if conv % 7 == 0:
            roles = [rng.choice(["user", "assistant", "system", "tool", None, "a</s>b", "start"]) for _ in range(5)]
        rows += [(conv, turn, role, rng.choice(TEXTS)) for turn, role in enumerate(roles[: rng.randint(1, 8)])]
    return rows + [(None, 0, "user", "no id"), (61, None, "user", "a"), (61, 1, "assistant", "b"), (62, 1, "user", "b"), (62, 1, "user", "a"), (62, 1, "user", "a")]


def test_formatted_chats_read_back(spark):
    rows = chats()
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, valid int").repartition(3)
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", C.SAID), (-1, 1, "assistant", C.SAID)]:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    made = C.Template()
    expected = []
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        state, valid = "start", True
        for role, _ in turns:
            valid, state = valid and role in C.TEMPLATE.get(state, [0] * 4)[3] and role != "start" if state in C.TEMPLATE else False, role
        valid = valid and state in C.TEMPLATE and None in C.TEMPLATE[state][3]
        size = sum(len(part) for role, text in turns for _, part, _ in made.segments(role, text))
        expected.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), size, valid))
    assert sorted(map(tuple, C.op6(table).collect()), key=str) == sorted(expected, key=str)


def test_no_control_string_in_texts_and_every_text_comes_back():
    made, rng = C.Template(), random.Random(3)
    marks = [m for r in C.TEMPLATE.values() for m in r[:2] if m] + list(C.OTHER)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "/s>", "</s>", "[", "INST]", "[/INST]", "\\", "<<SYS>>", "a", ">"]) for _ in range(rng.randint(0, 9)))
        cut = made.escape(text)
        assert made.unescape(cut) == text and not any(m in cut for m in marks)
        whole = [(part, loss) for _, part, loss in made.segments("user", text)]
        assert list(made.turns(iter(whole))) == [("user", text)]


def test_templates_that_overlap_are_refused():
    with pytest.raises(ValueError):
        C.Template({"start": ("", "", False, ("user",)), "user": ("aba", "</s>", True, (None,))})


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in C.op6(none).collect()] == [-1]
