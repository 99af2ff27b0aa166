import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dagloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string, ids long, mask string, chars long"


def test_digests(spark):
    said = "</s>[INST] ok [/INST] \\ <|endoftext|> [\\INST]"
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", said), (1, 2, "assistant", None), (2, 1, None, "x"), (2, 0, "assistant", ""),
        (3, 0, "user\n", "two\nlines"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, None, "assistant", "no id"), (None, 0, "user", "é漢🙂"),
        (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    ]
    df = spark.createDataFrame([(*r, 5, "m", 6) for r in rows], TURNS)
    got = {r.conv_id: r for r in chat.conversation_digests(chat.read_turns(chat.format_turns(df))).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.read_turns(chat.format_turns(df.limit(0)))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("\\[]<>/|sINTSYim_ x\n")), max_size=30), st.lists(st.sampled_from(chat.CONTROL), max_size=3))
def test_escape(text, controls):
    text += "".join(controls) + text
    coded = chat.escape(text)
    assert chat.unescape(coded) == text
    assert not any(c in coded for c in chat.CONTROL)


def test_mask_is_the_assistants_text():
    make = chat.assembler("byte_bpe_50k.json")
    ids, mask, first = make.assemble(["user", "assistant", "assistant"], ["<|endoftext|>", "", "two </s> words"], [False, True, True])
    assert first.tolist()[0] == 0 and first[-1] == len(ids) == len(mask)
    assert not mask[: first[2]].any() and (ids[mask.astype(bool)] < make.start).all()
    assert np.count_nonzero(ids >= make.start) == 9
    assert make.read(ids[first[2] :], mask[first[2] :])[:3] == ("assistant", "two </s> words", "two </s> words")
