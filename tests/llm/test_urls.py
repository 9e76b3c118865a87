"""Path templates of hosts whose variable segments are words."""

from collections import Counter

from quoteloom.llm import urls


def plain_templates(rows, share=urls.LITERAL_SHARE):
    """Depth by depth on the templates so far, from a list of (host, segments)."""
    out = [()] * len(rows)
    for depth in range(max(len(s) for _, s in rows)):
        seen = Counter((h, out[i], s[depth]) for i, (h, s) in enumerate(rows) if len(s) > depth)
        whole = Counter()
        for (h, t, _), n in seen.items():
            whole[h, t] += n
        digit = lambda v: v.isdigit()
        out = [
            t if len(s) <= depth else (*t, s[depth] if not digit(s[depth]) and seen[h, t, s[depth]] >= share * whole[h, t] else "*")
            for t, (h, s) in zip(out, rows, strict=True)
        ]
    return out


def test_words_below_a_variable_segment_are_pooled(spark):
    """Two levels of words, a host of many rare ones beside frequent ones, and paths that end early."""
    blog = [("blog.com", ("u" + "xyz"[i % 3] + f"-{i}", f"post-{i}-of-many")) for i in range(400)]
    shop = [("shop.com", ("shop", f"maker-{i % 90}", f"thing-{i}", "reviews", str(i))) for i in range(600)] + [("shop.com", ("about",))] * 40
    rows = blog + shop + [("few.com", ("a", "b")), ("few.com", ())]
    pages = spark.createDataFrame([(i, f"http://{h}/" + "/".join(s)) for i, (h, s) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: tuple(r.template) for r in urls.judge(pages).collect()}
    assert got == dict(enumerate(plain_templates(rows)))
    assert {got[i] for i in range(400)} == {("*", "*")}
    assert {got[i] for i in range(400, 1000)} == {("shop", "*", "*", "reviews", "*")}
    branches = Counter((rows[i][0], t[:d]) for i, t in {(i, t) for i, t in got.items()} for d in range(len(t)))
    assert branches and max(len({t[len(p)] for i, t in got.items() if rows[i][0] == h and t[: len(p)] == p and len(t) > len(p)}) for h, p in branches) <= 51
