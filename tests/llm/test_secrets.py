import base64
import bz2
import gzip
import hashlib
import re
import urllib.parse
import zlib

import zstandard

from neardup.llm import secret_scan as S

SECRET = "secret=Sup3rS3cretValue"


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def spans(text):
    return [(S.KINDS[k], text[a:b]) for a, k, b in sorted(S.scan(text)[1])]


def test_layers_are_unwrapped_and_mapped():
    inner = b64(SECRET).rstrip("=")
    assert spans(f"é {b64(SECRET)} x") == [("assign", inner)]
    assert spans("é " + urllib.parse.quote(SECRET) + " x") == [("assign", "secret%3DSup3rS3cretValue")]
    assert spans("".join(f"\\u{ord(c):04x}" for c in SECRET))[0][0] == "assign"
    assert spans("&#115;ecret&#x3D;Sup3rS3cret") == [("assign", "&#115;ecret&#x3D;Sup3rS3cret")]
    for pack in (gzip.compress, zlib.compress, bz2.compress, zstandard.compress, lambda x: gzip.compress(zlib.compress(x))):
        run = b64(pack(SECRET.encode()))
        assert spans("a " + run + " b") == [("assign", run)]
    nested = urllib.parse.quote(b64(zlib.compress(b64("x " + b64(SECRET)).encode())), safe="")
    assert ("assign", nested) in spans("in " + nested + " out")
    raw = "".join(f"%{b:02x}" for b in gzip.compress(SECRET.encode()))
    assert spans(raw) == [("assign", raw)]


def test_a_find_maps_to_its_own_characters():
    text = "p=" + b64("abc " + SECRET + " 日本")
    (a, _, b), = S.scan(text)[1]
    assert base64.b64decode(text[2:a + (4 - (a - 2) % 4) % 4][:(a - 2) // 4 * 4]) in b"abc " and a > 2 and b < len(text)


def test_base_finds():
    text = ('token: "abcdef" PassWord="short" api-key=abcdefgh API_KEY : xyz123.-_ ' + "AKIA" + "B" * 16 + " AKIA" + "B" * 15
            + " " + "0123456789abcdef" * 2 + " " + "a" * 23 + " ſecret=abcdefgh passwd=secret=abcdefgh")
    base = S.scan(text)[0]
    want = [(m.start(), 0, m.end()) for m in re.finditer(
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    assert base == sorted(want) and {k for _, k, _ in base} == {0, 1, 2}


def test_cycles_and_damage_end():
    assert S.scan("%2525252525" * 50)[3]
    for junk in ("H4sIAAAAAAAA" * 4, b64(gzip.compress(b"x" * 1000)[:-9]), b64(b"\x28\xb5\x2f\xfdjunkjunkjunk"), "\\u{110000} \\ud800 &#9999999;", "%ff%fe%00"):
        S.scan(junk)


def test_query_form(spark):
    rows = [(1, "a " + b64(SECRET), "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "token=abcdef1 " + "word " * 50000, "x")]
    got = S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].n_assign == 0 and by[1].spans.startswith("assign:2:")
    assert by[2].spans == "" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[None].base_sha256 == hashlib.sha256(b"assign:0:13").hexdigest() and by[None].complete
    assert S.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_unicode_escapes_end_after_four_digits_or_at_the_brace():
    for text in ("token\\u003dabc123def4567890", "password=\\u0022deadbeef99\\u0022", "tok\\u{65}n=abcdef12", "token\\u{3d}abcdef12",
                 "token\\u{00003d}abcdef12", "&#116;oken=abcdef12"):
        assert [k for k, _ in spans(text)] == ["assign"], text


def wrapped(x, columns, feed="\n"):
    run = b64(x)
    return feed.join(run[i:i + columns] for i in range(0, len(run), columns))


def test_wrapped_base64_members_encodings_and_short_ends():
    import lzma
    import random
    noise = random.Random(4).randbytes(600).hex()
    noise = " ".join(noise[i:i + 12] for i in range(0, len(noise), 12))
    long = (noise + " " + SECRET + " " + noise).encode()
    for feed in ("\n", "\r\n", "\n  ", "\\n"):
        for columns in (64, 76):
            for data in (gzip.compress(long), long, gzip.compress(long[:300]) + gzip.compress(long[300:])):
                text = "x: " + wrapped(data, columns, feed) + "\nNext words here"
                _, found, _, whole = S.scan(text)
                assert "assign" in {S.KINDS[k] for _, k, _ in found} and whole, (feed, columns)
    half = len(SECRET) // 2
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress, lambda x: lzma.compress(x, preset=9)):
        run = b64(pack(SECRET[:half].encode()) + pack(SECRET[half:].encode()))
        assert spans("a " + run + " b") == [("assign", run)] and S.scan("a " + run)[3]
    for data in (SECRET.encode("utf-16-le"), SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), b"\x01\xe9 " + SECRET.encode() + b" \xff"):
        assert [k for k, _ in spans("a " + b64(data) + " b")] == ["assign"]
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
        assert not S.scan("a " + b64(pack(long)[:-9]))[3]


def test_percent_spans_are_those_of_the_bytes():
    escaped = "".join(f"%{b:02X}" for b in SECRET.encode())
    for before in ("%E2%82", "%FF", "%EF%BF%BD", "%E2%82%AC", "%F0%9F%98", "%C3%28", ""):
        text = "é " + before + escaped + " x"
        assert spans(text) == [("assign", escaped)], before


def test_base64_after_characters_of_its_alphabet():
    import lzma
    for before in ("", "a", "ab", "abc", "data/", "https/host/path/", "x-y_z/"):
        for pad in ("", " ", "  "):
            (kind, part), = spans("see " + before + b64(pad + SECRET) + " there")
            assert kind == "assign" and part in b64(pad + SECRET).rstrip("=") and len(part) >= len(SECRET)
        for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
            run = b64(pack(SECRET.encode()))
            got = spans("see " + before + run + " there")
            # a packer may store so short a text as it is; then it is found at its own place too
            assert ("assign", run) in got and all(kind == "assign" and part in run for kind, part in got), (before, pack)
    assert [k for k, _ in spans("x " + b64("a " + SECRET).rstrip("=") + "A y")] == ["assign"]


def test_random_bytes_are_whole_and_without_finds():
    import random
    rng = random.Random(11)
    for _ in range(300):
        _, found, _, whole = S.scan("run " + b64(rng.randbytes(rng.randint(12, 400))))
        assert not found and whole


def test_random_nestings_are_found():
    import random
    rng = random.Random(12)
    wraps = [lambda t: b64(t), lambda t: b64(gzip.compress(t.encode())), lambda t: b64(zstandard.compress(t.encode())),
             lambda t: "".join(f"%{b:02x}" for b in t.encode()), lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
             lambda t: "path/" + b64("é " + t), lambda t: "%E2%82" + urllib.parse.quote(t, safe="")]
    for _ in range(150):
        text = SECRET
        for _ in range(rng.randint(1, 3)):
            text = rng.choice(wraps)(rng.choice(["", "k ", "ü: "]) + text + rng.choice(["", " end"]))
        a = "before " + rng.choice(["", "日本 "])
        found = S.scan(a + text + " after")[1]
        assert any(k == 0 and len(a) <= i < j <= len(a) + len(text) for i, k, j in found), text
