"""Line-block distribution on pages without marks, against an implementation of its own over the standard library's parser."""

import random
import re
from html.parser import HTMLParser

import pytest

from meterflow.llm.extraction import extract, main_text

DROPPED = {"nav", "aside", "form", "footer"}
LONG = "a long paragraph of the article that says very much about its matter, so that a window of lines rises above the threshold "


class Blocks(HTMLParser):
    """Lines as [kind, text, text outside links]; kind p for paragraphs and headings, d for others, g for what is dropped."""

    def __init__(self, page):
        super().__init__()
        self.lines, self.depth, self.link, self.kind, self.now = [], 0, False, "d", ["", ""]
        self.feed(page)
        self.flush()

    def flush(self):
        text = re.sub(r"\s+", " ", self.now[0]).strip()
        if text:
            self.lines.append([self.kind, text, max(0, len(text) - len(self.now[1]))])
        self.now = ["", ""]

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            if not self.depth:
                self.flush()
            self.depth += 1
        elif not self.depth and tag == "a":
            self.link = True
        elif not self.depth:
            self.flush()
            self.kind = "p" if tag in ("p", "h2", "li") else "d"

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.depth -= 1
            if not self.depth:
                self.lines.append(["g", "", 0])
        elif tag == "a":
            self.link = False
        elif not self.depth:
            self.flush()
            self.kind = "d"

    def handle_data(self, data):
        if not self.depth:
            self.now[0] += data
            self.now[1] += data if self.link else ""


def by_definition(page, window=3, threshold=80):
    lines = Blocks(page).lines
    text = [i for i, x in enumerate(lines) if x[0] != "g"]
    spread = []
    for i, x in enumerate(lines):
        if x[0] != "g":
            spread.append(x)
            continue
        before, after = max((j for j in text if j < i), default=None), min((j for j in text if j > i), default=None)
        if before is None or after is None or lines[before][0] != "p" or lines[after][0] != "p":
            spread += [["g", "", 0]] * window
    sums = [sum(x[2] for x in spread[i : i + window]) for i in range(len(spread))]
    runs = [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if s else "." for s in sums))]
    size = [sum(x[2] for x in spread[a:b]) for a, b in runs]
    kept = [r for r in runs if max(sums[slice(*r)]) > threshold] or ([runs[size.index(max(size))]] if runs else [])
    return "\n".join(x[1] for a, b in kept for x in spread[a:b] if x[1])


def page(rng):
    parts = []
    for _ in range(rng.randrange(1, 14)):
        parts.append(
            rng.choice(
                [
                    lambda: f"<p>{LONG * rng.randrange(1, 3)}{rng.randrange(99)}</p>",
                    lambda: f"<p>Short {rng.randrange(99)}.</p>",
                    lambda: f"<h2>Heading {rng.randrange(99)}</h2>",
                    lambda: "<nav><ul><li>Menu</li></ul></nav>",
                    lambda: "<aside><p>Beside</p></aside>",
                    lambda: "<form><p>Name</p></form>",
                    lambda: f"<div>bare {rng.randrange(99)}</div>",
                    lambda: "<ul>" + "".join(f"<li><a href='#'>link {i}</a></li>" for i in range(rng.randrange(1, 6))) + "</ul>",
                    lambda: f"<p>with <a href='x'>a link</a> in {rng.randrange(99)}</p>",
                ]
            )()
        )
    return "<html><body>" + "\n".join(parts) + "</body></html>"


def test_unmarked_pages():
    rng = random.Random(8)
    seen = 0
    for _ in range(1500):
        p = page(rng)
        assert main_text(p) == by_definition(p), p
        seen += "Short" in main_text(p)
    assert seen > 300


@pytest.mark.parametrize("beside", ["<nav>..</nav>", "<aside><p>Other</p></aside>", "<form><input></form>"])
def test_short_lines_beside_dropped_elements(beside):
    assert main_text(f"<p>Short one.</p>{beside}<p>{LONG}</p>{beside}<p>Closing words.</p>").split("\n") == ["Short one.", LONG.strip(), "Closing words."]
    assert main_text(f"<div>Slogan</div>{beside}<p>{LONG}</p>{beside}<div>Imprint</div>") == LONG.strip()


def test_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(none).collect() == []
    rows = [(1, f"<p>{LONG}</p>", "old", 3), (2, None, None, None), (3, "", "x", 0)]
    out = extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars long"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in out.collect()) == [(1, LONG.strip(), len(LONG.strip())), (2, "", 0), (3, "", 0)]
    assert main_text("<p>" + "word " * 400_000 + "</p>") == ("word " * 400_000).strip()
