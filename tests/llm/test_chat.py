from neardup.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, speaker string, page int"
ROWS = [(1, 0, "system", "be kind", "x", 1), (1, 1, "user", "hi", "x", 1), (1, 2, "assistant", "hello é😀", "x", 1),
        (1, 3, "user", None, "x", 1), (1, 3, "user", None, "x", 1), (1, 3, "critic", "no\nno", "x", 1),
        (2, None, None, "who", None, None), (2, 0, "", "me", None, None), (None, 0, "user", "lost", None, None),
        (None, 1, "bot", "found", None, None), (3, 0, "system", "alone", None, None)]


def brute(rows, page_chars):
    out = []
    turns = [(c, t, r or "unknown", x or "") for c, t, r, x, *_ in rows]
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        for target in {t[2] for t in own} - {"system"}:
            pages, at = {}, 0
            for _, _, who, text in own:
                head = "<|system|>\n" if who == "system" else "<|assistant|>\n" if who == target else f"<|user|> {who}\n"
                piece = head + text + "\n<|end|>\n"
                page = pages.setdefault(at // page_chars, [at, 0, "", []])
                page[1] += 1
                page[2] += piece
                if who == target:
                    page[3].append(f"{at + len(head)}:{at + len(head) + len(text)}")
                at += len(piece)
            out += [(conv, target, k, p[0], p[1], p[2], ",".join(p[3])) for k, p in pages.items()]
    return sorted(out, key=str)


def test_rotations_are_those_of_brute_force(spark):
    rows = ROWS + [(9, i // 3, ["user", "assistant", "judge"][i % 3], f"turn {i}", None, None) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = chat.rotate_perspectives(df, page_chars=500).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 500)


def test_masks_cover_the_targets_words_only(spark):
    got = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(spark.createDataFrame(ROWS[:6], SCHEMA)).collect()}
    r = got[(1, "assistant")]
    first, last = map(int, r.masks.split(":"))
    assert r.text[first:last] == "hello é😀"


def test_empty_table(spark):
    assert chat.rotate_perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
