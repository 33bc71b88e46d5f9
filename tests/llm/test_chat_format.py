"""Dialogues of many and of sparse turn numbers are rendered whole."""

import pytest

from noteloom.llm import chat_format


@pytest.mark.parametrize("step", [1, 1000])
def test_long_and_sparse_dialogues_are_whole(spark, step):
    turns = [(0, "system", "be kind")] + [(i * step, "ann" if i % 2 else "bob", f"text {i}") for i in range(1, 601)]
    rows = chat_format.rotate(spark.createDataFrame([(1, *t) for t in turns][::-1], "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r["perspective"] for r in rows) == ["ann", "bob"]
    for r in rows:
        want, mask = "", []
        for _, role, text in turns:
            name = "system" if role == "system" else "assistant" if role == r["perspective"] else f"user name={role}"
            want += f"<|im_start|>{name}\n"
            if role == r["perspective"]:
                mask.append(f"{len(want)}:{len(want) + len(text) + len(chat_format.END)}")
            want += text + chat_format.END
        assert (r["rendered"], r["mask"], r["n_turns"]) == (want, ",".join(mask), 601)
