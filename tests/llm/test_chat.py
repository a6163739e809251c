from genoloom.llm import chat


def rendered(messages, participant):
    return "".join(f"<|im_start|>{'assistant' if s == participant else f'user name={s}'}\n{t}<|im_end|>\n" for s, t in messages)


def test_chunks_go_by_position(spark):
    """Null turns, tied turns and far turns are cut alike, by the places of their messages."""
    rows = [(1, None, "ann", f"n{i:03d}") for i in range(100)] + [(1, 5, "bob", f"t{i:03d}") for i in range(90)] + [(1, i << 40, "cy", "far") for i in range(1, 4)] + [(2, None, None, None)] * 3
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, CHUNK string")
    got = sorted(chat.rotate(df, block=16).filter("conv_id = 1 AND participant = 'bob'").collect(), key=lambda r: r.chunk)
    order = [(s, t) for _, _, s, t in sorted(rows[:-3], key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))]
    assert [r.chunk for r in got] == list(range(13)) and {r.n_chunks for r in got} == {13} and [r.first_message for r in got] == list(range(0, 193, 16))
    assert [r.n_messages for r in got] == [16] * 12 + [1]
    for r in got:
        own = order[r.first_message : r.first_message + r.n_messages]
        assert r.rendered == rendered(own, "bob")
        assert [r.rendered[a:b] for a, b in zip(r.mask_starts, r.mask_ends, strict=True)] == [f"{t}<|im_end|>\n" for s, t in own if s == "bob"]
    other = chat.rotate(df).filter("conv_id = 2").collect()
    assert [(r.participant, r.n_messages, r.rendered) for r in other] == [("unknown", 3, rendered([("unknown", "")] * 3, "unknown"))]


def test_empty_table(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
