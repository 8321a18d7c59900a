"""Block rules of pages: broken markup, time, and the two passes against plain loops."""

import random
import time

import pytest

from plumbline.llm import html

PROSE = "It was one of the days when all that could be seen from the house was the road and the trees by the water, and there was not a sound to be heard in the valley. "


@pytest.mark.parametrize(
    "page",
    [
        "<p>{a}</p><svg viewBox='0 0 1 1' /><p>{b}</p>", "<p>{a}</p><svg><path d='x'/></svg><p>{b}</p>", "<p>{a}</p><select><option>x<p>{b}</p>", "<noscript><p>{a}</p><p>{b}</p>", "<p>{a}</p><video src=x><p>{b}</p>",
        "<p class='login-help'>{a}</p><p class='login-help'>{b}</p>", "<h1>Title</h1><div class='notice-board'><p>{a}</p><p>{b}</p></div>", "<p title=it's>{a}</p><p title='a > b'>{b}</p>", "<head><p>{a}</p><head><p>{b}</p>", "<p>{a}</p><script>if (a </b) x</script ><p>{b}</p>",
    ],
)
def test_no_text_is_lost(page):
    text = html.main_text("<body>" + page.format(a=PROSE + "First.", b=PROSE + "Second."))
    assert "First." in text and "Second." in text


def test_formulas_are_text():
    assert "where x = y holds" in html.main_text(f"<article><p>{PROSE} where <math><mi>x</mi> <mo>=</mo> <mi>y</mi><annotation>tex</annotation></math> holds</p></article>").replace("  ", " ")


def test_marked_places_stay_out():
    page = f"<nav><p>{PROSE}</p></nav><h1>Head</h1><p>{PROSE}Main.</p><div class=comments><p>{PROSE}Comment.</p></div><script>never {PROSE}"
    text = html.main_text(page)
    assert "Main." in text and "Comment." not in text and text.count("valley") == 1
    assert html.main_text(f"<nav><p>{PROSE}</p></nav><form>{PROSE}</form>").count("valley") <= 1


@pytest.mark.parametrize("part", ["<head>", "<select>", "<svg>", "<p title=\"", "<a '", "<!--", "<div class='x' ", "</p>", "<p>", "&amp", "<a href=x>", "<", "<svg/>", "= \"", "<x a='"])
def test_broken_pages_take_linear_time(part):
    page = "<p>" + PROSE + "</p>" + part * ((1 << 20) // len(part))
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 6


def plain(blocks):
    """Both passes as the rules say, each neighbour sought from the block itself."""
    counts = [html._stop_words(b.text) for b in blocks]
    open_ = [c for b, c in zip(blocks, counts, strict=True) if b.prior != html.SURE]
    known = sum(s for s, _ in open_) >= 0.05 * sum(n for _, n in open_)
    label, scores = [], []
    for b, (stop, n) in zip(blocks, counts, strict=True):
        dense = (min(stop / n, 0.3) - 0.08) / 0.22 if known else 0.7
        own = 2 * min(1.0, len(b.text) / 140) * dense - 3 * b.linked / len(b.text.replace(" ", ""))
        scores.append(own)
        label.append(True if own + b.prior >= 1.2 else False if own + b.prior <= -0.5 else None)
    if all(b.prior == html.SURE or b.heading or label[i] is False for i, b in enumerate(blocks)):
        label = [True if b.prior == html.SURE and b.tag not in html.BOILER and scores[i] >= 1.2 else label[i] for i, b in enumerate(blocks)]

    def nearest(i, fits):
        for away in range(1, len(blocks)):
            for j in (i - away, i + away):
                if 0 <= j < len(blocks) and label[j] is not None and fits(j):
                    return label[j]
        return None

    free = lambda j: blocks[j].prior != html.SURE
    first = next((i for i, b in enumerate(blocks) if label[i] is None and b.heading), None) if not any(label) else None
    out = []
    for i, b in enumerate(blocks):
        found = label[i]
        if found is None and b.heading:
            found = next((label[j] for j in range(i + 1, len(blocks)) if label[j] is not None and free(j)), None)
        if found is None:
            found = nearest(i, lambda j, b=b: free(j) and (blocks[j].tag, blocks[j].parent) == (b.tag, b.parent))
        if found is None and b.prior == html.ARTICLE:
            found = True
        if found is None and first is not None and i >= first:
            found = b.linked == 0
        if found is None:
            found = nearest(i, lambda j: True)
        out.append(b.linked == 0 if found is None else found)
    return out


def test_two_passes_equal_plain_loops():
    rng = random.Random(6)
    words = PROSE.split() + ["Quartz", "zinc", "vex", "jumbo"] * 6
    for _ in range(400):
        page = []
        for _ in range(rng.randint(1, 14)):
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 20, 40])))
            text = f"<a href=x>{text}</a>" if rng.random() < 0.2 else text
            tag = rng.choice(["p", "p", "p", "li", "h2", "div", "td", "nav"])
            mark = rng.choice(["", "", "", " class=sidebar", " class=promo"])
            page.append(f"<{tag}{mark}>{text}</{tag}>")
        whole = f"<article>{''.join(page)}</article>" if rng.random() < 0.4 else "".join(page)
        got = html.judged(whole)
        assert [b.good for b in got] == plain(html.blocks(whole))
