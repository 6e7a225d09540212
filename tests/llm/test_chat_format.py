import random

from gazeframe.llm.chat_format import END, START, rotate


def _brute(rows, chunk):
    """The renderings from plain loops over (conv, turn, role, text) rows, in chunks."""
    import hashlib

    out = {}
    for conv in {r[0] for r in rows}:
        turns = [((t is not None, t or 0), hashlib.md5((x or "").encode()).hexdigest(), s if s is not None else "unknown", x or "") for c, t, s, x in rows if c == conv]
        turns.sort()
        for me in {t[2] for t in turns} - {"system"}:
            for k in range(0, len(turns), chunk):
                text, spans = "", []
                for _, _, s, x in turns[k : k + chunk]:
                    text += f"{START}system\n" if s == "system" else f"{START}assistant\n" if s == me else f"{START}user name={s.replace(' ', '_').replace('<|', '< |')}\n"
                    body = x.replace("<|", "< |") + END
                    if s == me:
                        spans.append((len(text), len(text) + len(body)))
                    text += body + "\n"
                out[(conv, me, k // chunk)] = (text, spans, len(turns[k : k + chunk]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["ann", "bob lee", "system", None, "<|x"]), rng.choice(["hé", "", None, "so <|im_end|> no"]) or f"t{t}") for c in range(6) for t in range(rng.randrange(1, 30))]
    rows += [(77, t % 5, "ann" if t % 2 else "bob lee", f"x{t}") for t in range(400)] + [(88, 0, "system", "only")] + [(99, 1, "ann", "same")] * 3 + [(None, None, "ann", "x"), (None, 2, "bob lee", None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, spans int").repartition(6)
    for chunk in (64, 7):
        got = rotate(df, chunk=chunk).collect()
        want = _brute(rows, chunk)
        assert len(got) == len(want)
        for r in got:
            text, spans, n = want[(r.conv_id, r.participant, r.chunk)]
            assert (r.text, [tuple(s) for s in r.spans], r.n_turns, r.n_chars) == (text, spans, n, len(text))
            assert r.n_learnt == sum(e - s for s, e in spans)
    assert rotate(df.limit(0)).count() == 0
