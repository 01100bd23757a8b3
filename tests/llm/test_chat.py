"""Chat formatting: exact round trips and masks."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import catalog, chat

TEMPLATE = chat.Template()
PARTS = [*TEMPLATE.control, "\\", "<", "[", ">", "]", "S", "INST]", "[\\INST]", "<\\\\s>", " ", "é日", "x"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    """By conversation: turns in order and the columns they give."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, role or "", TEMPLATE.hide(text or ""), text or ""))
    out = {}
    for conv, turns in by.items():
        turns = sorted(turns)
        learnt = "".join(t for *_, r, _, t in turns if r == "assistant")
        out[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, _, t in turns)), len(learnt), sha(learnt)
    return out


def made(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS)).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    hidden = TEMPLATE.hide(text)
    assert TEMPLATE.show(hidden) == text
    assert not any(c in hidden for c in TEMPLATE.control)
    assert hidden == text or any(c in text.replace("\\", "") for c in TEMPLATE.control)


def test_template_refuses_marks_that_overlap():
    for turns in ((("user", "<u>", "<u>"),), (("user", "ab", "bc"),), (("user", "", "</u>"), ("system", "", "</y>")), (("user", "<u>", ""),), (("user", "<u\\", "</u>"),), (("user", "aba", "</u>"),)):
        with pytest.raises(ValueError):
            chat.Template(turns=turns, more=())


def test_chat_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    got = catalog.op12_chat(spark, sf_dir)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "consistent"]
    assert made(got) == expected(rows) and got.filter("NOT consistent").count() == 0


def awkward():
    rng = random.Random(4)
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (2, None, "tool", "[ROLE]x[/ROLE]"), (2, 0, "user", "hi"), (2, 0, "user", "hi"),
            (2, 0, "assistant", "hi"), (None, 1, "user", "q"), (None, 2, "assistant", "\\</s>"), (3, 0, "[/ROLE]\\", "y"), (4, 0, "assistant", "word " * 50_000), (5, 9, "system", "<<SYS>>\n"), (6, 0, "", "z")]
    return rows + [(7, k, rng.choice(["user", "assistant", "system", "tool"]), "".join(rng.choices(PARTS, k=12))) for k in range(300)]


def test_chat_odd(spark):
    docs = spark.createDataFrame([(*r, "c", "c") for r in awkward()], "conv_id long, turn long, role string, text string, part string, ids string")
    tokenizer = catalog.default_tokenizer()
    for part in (chat.PART, 50):
        parts = chat.formatted(docs, tokenizer, part=part)
        got = chat.digests(parts, tokenizer)
        assert made(got) == expected(awkward()) and got.filter("NOT consistent").count() == 0
        assert parts.filter("last").count() == 8 and (part > 50 or parts.count() > 20)
    assert chat.formatted(docs.limit(0), tokenizer).count() == 0 and chat.digests(chat.formatted(docs.limit(0), tokenizer), tokenizer).count() == 0


def test_ids_are_those_of_the_segments(spark):
    """Reserved ids only where a mark stands; contents are encoded by themselves; the mask holds the answers alone."""
    docs = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "user", "Hi </s> there"), (1, 2, "assistant", "Hello [INST]")], "conv_id long, turn long, role string, text string")
    r = chat.formatted(docs, catalog.default_tokenizer()).first()
    form = chat.formatter(TEMPLATE, catalog.default_tokenizer())
    assert r.text == "<s><<SYS>>Be brief.<</SYS>>[INST]Hi <\\/s> there[/INST]Hello [\\INST]</s>"
    plain = [form.encode.tokenizer.encode(t, add_special_tokens=False).ids for t in ("Be brief.", "Hi <\\/s> there", "Hello [\\INST]")]
    m = form.id
    assert np.frombuffer(r.ids, "<u4").tolist() == [m["<s>"], m["<<SYS>>"], *plain[0], m["<</SYS>>"], m["[INST]"], *plain[1], m["[/INST]"], *plain[2], m["</s>"]]
    assert sum(r.mask) == len(plain[2]) and r.mask[-1] == 0 and min(m.values()) == 50257
