from frametide.llm import line_dedup as L

SCHEMA = "doc_id long, text string, source string, gone__ string, k1__ int"


def brute(rows, t, least=3):
    sites, first = {}, {}
    for i, text, s in rows:
        for p, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(line.split()) >= least:
                sites.setdefault(line, set()).add(s)
                key = (i is not None, i or 0, p)
                first[line] = min(first.get(line, key), key)
    spread = {x for x, s in sites.items() if len(s - {None}) >= t}
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        lines = text.split("\n")
        kept = [x for p, x in enumerate(lines) if x not in spread or first[x] == (i is not None, i or 0, p)]
        out.append((i, "\n".join(kept), len(lines) - len(kept)))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2])


def test_against_brute_force(spark):
    foot, near, rare = "read more on our site", "share this with your friends", "only on few sites here"
    rows = [(i, f"own text number {i} here\n{foot}" + (f"\n{near}" if i < 11 else "") + (f"\n{rare}" if i < 4 else "") + "\nhi", f"s{i % 30}") for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s2"), (102, foot, "s3"), (103, f"{foot}\n{foot}\n\n{foot}", None), (None, f"{foot}\nnull id", "s4"), (5, rows[5][1], "s5"), (5, rows[5][1], "s5")]
    rows += [(200 + i, "same site line again", "one") for i in range(40)] + [(300 + i, "site without a name", None) for i in range(30)] + [(400 + i, "é ü ß\tx" + " " * (i % 2), f"t{i}") for i in range(24)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    for t, sent in ((10, 1000), (11, 1000), (11, 0), (12, 0), (30, 1000)):
        out = L.clean(df, min_sites=t, removed="n_removed", sent_lines=sent)
        assert out.columns == [*df.columns, "n_removed"]
        got = sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=key)
        assert got == sorted(brute(rows, t), key=key)


def test_every_line_gone_and_empty(spark):
    df = spark.createDataFrame([(i, "one shared line of text", f"s{i}", "x", 1) for i in range(12)], SCHEMA)
    assert sorted(r.text for r in L.clean(df).collect()) == [""] * 11 + ["one shared line of text"]
    assert L.clean(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    foot = "read more on our site"
    long = "\n".join([*(f"line {i} of many lines" for i in range(100_000)), foot, "x " * 500_000])
    df = spark.createDataFrame([(i, f"text {i}\n{foot}", f"s{i}", "x", 1) for i in range(12)] + [(50, long, "s1", "x", 1)], SCHEMA)
    for sent in (1000, 0):
        got = {r.doc_id: r.text for r in L.clean(df, sent_lines=sent).collect()}
        assert got[50] == long.replace(foot + "\n", "") and got[0].endswith(foot) and got[3] == "text 3"
