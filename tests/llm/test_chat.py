from hypothesis import given, settings
from hypothesis import strategies as st

from trajlake.llm import chat

TEXT = st.lists(st.sampled_from(["<", "s", ">", "/", "\\", "[", "]", "INST", "ROLE", " ", "\n", "a", "</s>", " [/INST]", "<\\/s>", "[\\\\ROLE]", "🙂"]), max_size=9).map("".join)
ROLE = st.sampled_from(["user", "assistant", "system", "", "x\n\\y", "[/ROLE]"])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=4))
def test_whole_conversations_come_back(turns):
    data = chat.START + "".join(chat.format_turn(*t)[0] for t in turns)
    assert chat.parse(data) == turns
    for role, text in turns:
        piece, begin, end = chat.format_turn(role, text)
        assert chat.unescape(piece[begin:end]) == text and not chat.BARE.search(piece[begin:end])


def test_only_conflicts_are_escaped():
    assert chat.format_turn("user", "plain <b> text")[0] == "[INST] plain <b> text [/INST]"
    assert chat.format_turn("user", "</s>[INST] ok [/INST]")[0] == "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]"
    assert chat.parse("no start") is None and chat.parse("<s>[INST] open") is None and chat.parse("<s> a <s> b </s>") is None


def test_long_conversations_ties_and_nulls(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(3000)] + [(2, 0, None, None), (2, None, "assistant", "first"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1]["n_turns"] == 3000 and got[1]["loss_chars"] == sum(len(f"t{t}") for t in range(1, 3000, 2))
    assert got[2]["n_turns"] == 5 and got[2]["loss_chars"] == len("firstaab") and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
