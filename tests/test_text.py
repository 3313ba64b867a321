import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from turnmill.functions import calendar as C, identity as I, markers as M, stats, text as T

SECRETS = {
    "the password is Hunter2!x": "the password=[REDACTED]", "psk Tr0ub4dor3": "psk=[REDACTED]",
    "wifi key abc12345": "wifi key=[REDACTED]", "password: sekritvalue1": "password=[REDACTED]",
}
HARMLESS = ["the password is wrong", "password reset email", "my token store", "passwd prompt appeared", "boarding pass QF12345",
            "pwd C:/Users/me/project1", "psk=plainword", "password is password hunter22", "2026-06-14", "07/09/2026", "v0.8.0", "0x04",
            "129424534", "PEX 543 777 2996", "1,656 sessions"]
PHONES = ["07 5477 4500", "+61 400 123 456", "0400123456", "052-1234567", "03-1234567", "+14155552671", "(02) 9876 5432",
          "+1 (415) 555-2671", "07700 900123", "+49 151 12345678"]


def one(spark, columns, **values):
    return tuple(spark.createDataFrame([tuple(values.values())], list(values)).select(*columns).first())


def test_redaction(spark):
    wanted = {**SECRETS, **{h: h for h in HARMLESS}, **{p: "[PHONE]" for p in PHONES},
              "mail a.b@c.org from 10.0.0.1": "mail [EMAIL] from [IP]", "key sk-" + "a" * 24: "key [OPENAI_KEY]",
              "password plainwordverylong": "password=[REDACTED]"}
    got = spark.createDataFrame([(t,) for t in wanted], "t string").select("t", T.redact(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == wanted


def test_plain_fold_is_exact(spark):
    """Wherever the JVM path is taken it must equal the full fold, also beside other characters."""
    points = [chr(c) for c in range(1, 0x2100) if not 0xD800 <= c < 0xE000]
    words = points + [a + b for a, b in zip(points, points[1:])]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", T.nfkc_casefold(F.col("t"))).collect()
    assert all(f == unicodedata.normalize("NFKC", t).casefold() for t, f in got)


def test_tokens_of_other_scripts(spark):
    row = one(spark, [T.salience_tokens(F.col("t"))], t="Straße ﬁnd Ⅷ x_1 don't תמיד")
    assert row[0] == ["strasse", "find", "viii", "x_1", "don", "t", "תמיד"]


def test_pasted_log(spark):
    texts = {"a\n  at x\n  at y\nException\n": True, "one\ntwo\nthree\nfour": False, "  at x\n  at y": False,
             "a\nb\nc\nTraceback": False, "a\nb\nTraceback\nmain.py:3 boom": True}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.is_pasted_log(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == texts


@pytest.mark.parametrize("raw, want", [
    ("back to back <turn_aborted>a</turn_aborted><heartbeat>b</heartbeat> kept", "back to back  kept"),
    ("<heartbeat>never closed", "<heartbeat>never closed"), ("<skill>x</skill>", "<skill>x</skill>"),
    ('see <image name="a" path="/x"> here </image>', "see  here"),
    ("<codex_delegation\n a='1'>x\ny</codex_delegation>", ""),
])
def test_envelopes(spark, raw, want):
    assert one(spark, [T.strip_envelopes(F.col("t"))], t=raw) == (want,)


def test_excerpt_moves_to_the_marker(spark):
    text = "ab " * 80 + "as i said yes" + " cd" * 80
    shown, plain = one(spark, [T.excerpt(F.col("t"), F.lit("as i said")), T.excerpt(F.col("t"))], t=text)
    assert shown.startswith("...") and "as i said" in shown and shown.endswith("...")
    assert plain == text[:120].rstrip() + "..."


def test_fit_utf8(spark):
    for text in ("héllo wörld", "שלום אל", "a😀b😀c", ""):
        for limit in range(0, 14):
            want = text.encode()[:limit].decode("utf-8", "ignore")
            assert one(spark, [T.fit_utf8(F.col("t"), F.col("n"))], t=text, n=limit) == (want,), (text, limit)


def test_calendar(spark):
    got = one(spark, [
        C.quarter(F.col("a")), C.quarter(F.col("u")), C.stratum(F.lit("s"), F.col("a")), C.stratum(F.lit("s"), F.col("u")),
        C.months_between(F.col("a"), F.col("b")), C.months_between(F.col("a"), F.col("u")), C.message_date(F.col("t")),
        C.message_date(F.lit("soon")), C.date_from_millis(F.lit(1783963834101)), C.utc_millis(F.col("t")), C.utc_millis(F.col("a")),
        C.add_days(C.utc_millis(F.col("t")), 7)],
        a="2026-01-02", b="2027-03-04", u="undated", t="2026-01-02T03:04:05Z")
    assert got == ("2026-Q1", "unknown", "s:2026-Q1", "s:undated", 15, 0, "2026-01-02", "undated", "2026-07-13",
                   "2026-01-02T03:04:05.000Z", None, "2026-01-09T03:04:05.000Z")


def test_short_counts(spark):
    got = one(spark, [C.short_count(F.lit(n)) for n in (999, 3456, 1_234_567)], x=1)
    assert got == ("999", "3K", "1.2M")


def test_wilson_edges(spark):
    for k, n, low, high in ((0, 0, None, None), (0, 10, 0.0, 0.2775327998628892), (10, 10, 0.7224672001371106, 1.0)):
        assert one(spark, stats.wilson(F.lit(k), F.lit(n)), x=1) == pytest.approx((low, high)) if n else (None, None)


def test_identity(spark):
    path = "file:/home/me/.claude/projects/p/s.jsonl"
    hidden = "/x/antigravity/brain/abc/.system_generated/logs/transcript.jsonl"
    got = one(spark, [I.source_of(F.col("p")), I.source_of(F.col("h")), I.session_label(F.col("p")), I.session_label(F.col("h")),
                      I.canonical_json({"b": F.lit(1), "a": F.lit("é")})], p=path, h=hidden)
    assert got == ("claude", "antigravity", "p/s.jsonl", "abc/transcript.jsonl", '{"a":"é","b":1}')


def test_markers(spark):
    flags = {"no, not that": True, "no need for the repo": False, "the build is wrong": False, "wrong file": True}
    got = spark.createDataFrame([(t,) for t in flags], "t string").select("t", M.is_correction(T.usage_form(F.col("t")))).collect()
    assert {r[0]: r[1] for r in got} == flags
    assert one(spark, [M.restated_marker(F.col("t"))], t="well as i said before") == ("as i said",)
    assert one(spark, [M.domain_hints(F.col("t")), M.domain_hints(F.col("t"), None, True)], t="build it") == (["design"], ["work"])


def test_white_space_of_every_kind_is_collapsed(spark):
    """As by the Unicode property, and without looking it up for every character."""
    kinds = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    others = "a.\x1c\x1f\u180e\u200b\ufeffé"
    rng = random.Random(3)
    texts = ["".join(rng.choice(kinds if rng.random() < 0.5 else others + " ") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [*kinds, "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    flat, ends = T.collapse_space(F.col("text")), T.strip(F.col("text"))
    wide = F.regexp_replace(F.regexp_replace("text", r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")
    assert df.filter(~flat.eqNullSafe(wide) | ~ends.eqNullSafe(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "(?U)" not in str(flat) + str(ends)
