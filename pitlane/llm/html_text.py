"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its own word count and
link density, those of its two neighbours, and, second, what encloses it. A tree, grown here on a small
labelled table (labelled_blocks, made from page layouts whose parts are known), keeps or drops it.
"""

from __future__ import annotations

import html
import random
import re

from pyspark.sql import DataFrame

from pitlane.llm.common import lean

_BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_HOLDERS = _BLOCK - set("p dt dd hr option tr td th h1 h2 h3 h4 h5 h6 tbody thead tfoot".split())
_TEXT_HOLDERS = set("h1 h2 h3 h4 h5 h6 li".split())
_UNSEEN = "noscript|template|svg|math|object|canvas|audio|video|select|button"
_ATTRIBUTES = r"(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+"  # a quote opens a value only after "="
# groups: an element of raw text; the text of a title; slash, name and attributes of a tag
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|iframe)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    rf"|<title(?=[\s/>]){_ATTRIBUTES}>((?:(?!<title[\s/>]|</head[\s>]).)*?)</title(?=[\s/>])[^>]*(?:>|\Z)"
    rf"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
_UNSEEN_TAG = re.compile(rf"</?({_UNSEEN})(?=[\s/>])", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_HIDDEN = re.compile(r"""display\s*:\s*none|visibility\s*:\s*hidden|\bhidden\b(?!-)|aria-hidden\s*=\s*["']?true""", re.I)
_ASIDE = re.compile(
    r"(?:^|[^a-z])(?:ads?|adv|adverts?|advertisement|advertising|banner|promo\w*|sponsor\w*|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|foot|footer|site-?header|masthead|topbar|comments?|comment\w+|repl(?:y|ies)|respond|disqus|discussion|cookies?|consent|gdpr|notices?|notification|alert|newsletter|subscribe|subscription|sign-?up|log-?in|search|share|sharing|social|related|recommend\w*|more-stories|pop-?up|modal|overlay|toolbar|pagination|pager|widget\w*|copyright|legal|disclaimer|skip\w*|tags|meta|byline|complementary|contentinfo|alertdialog|form)(?:$|[^a-z])",
    re.I,
)
_NEGATED = re.compile(r"\b(?:no|has|with|without)[-_]\w+", re.I)
_MAIN = re.compile(r"(?:^|[^a-z])(?:article\w*|main|content|post|entry|story|text|body)(?:$|[^a-z])", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "main", "page_has_main", "heading", "item")
#: The first of FEATURES that count words and links.
TEXTUAL = 6


def _named(attributes: str) -> str:
    return _NEGATED.sub("", " ".join(x.strip("\"'") for x in _NAMES.findall(attributes)))


def _unseen_ends(page: str) -> dict[int, int]:
    """Where each unseen element of page ends, by where it starts. One without an end tag of its own has no entry."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    for tag in _TOKEN.finditer(page):
        unseen = _UNSEEN_TAG.match(page, tag.start())
        if not unseen:
            continue
        name = unseen[1].lower()
        if not tag[3] and name in ("svg", "math") and tag[0].endswith("/>"):
            ends[tag.start()] = tag.end()
            continue
        if tag[3] or name in ("select", "button"):  # these two end where the next of their kind starts
            for i in range(len(opened) - 1, -1, -1):
                if opened[i][0] == name:
                    if tag[3]:
                        ends[opened[i][1]] = tag.end()
                    del opened[i:]
                    break
        if not tag[3]:
            opened.append((name, tag.start()))
    return ends


def blocks(page: str) -> tuple[list[str], list[list[float]]]:
    """Texts and FEATURES of a page's flat blocks, in page order. Character references are decoded, white space is one space.

    Text of raw elements, of unseen elements that are closed and of a title in head is no block's. Head has no
    say beyond its title, so its end tag may be missing. Of an unseen element without an end tag only the start
    tag is skipped; raw text (script, style, textarea, iframe) without one goes on to the page's end, as in HTML.
    """
    texts: list[str] = []
    rows: list[list[float]] = []
    run: list[str] = []
    stack: list[tuple[str, int, int]] = []
    state = [0, 0, ""]
    linked, in_link, has_main = 0, False, 0
    in_head, ends = False, None

    def cut() -> None:
        nonlocal linked
        if run:
            words = "".join(run).split()
            if words:
                n = len(words)
                texts.append(" ".join(words))
                tag = state[2]
                rows.append([n, min(1.0, linked / n), 0, 0, 0, 0, state[0], state[1], 0, float(tag[:1] == "h"), float(tag == "li")])
            run.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text = page[at:lt]
            if "&" in text:
                text = html.unescape(text)
            run.append(text)
            if in_link:
                linked += len(text.split())
        if lt == end:
            break
        tag = _TOKEN.match(page, lt)
        if not tag:
            run.append("<")
            at = lt + 1
            continue
        at = tag.end()
        if tag[1]:
            if tag[1].lower() in _BLOCK:
                cut()
            continue
        if tag[2] is not None:
            cut()
            if not in_head:
                state[:] = [*((stack[-1][1], stack[-1][2]) if stack else (0, 0)), ""]
                run.append(html.unescape(tag[2]))
                in_link = False
                cut()
            continue
        if not tag[4]:
            continue
        name, closing = tag[4].lower(), bool(tag[3])
        if not closing and _UNSEEN_TAG.match(page, lt):
            if ends is None:
                ends = _unseen_ends(page)
            at = ends.get(lt, at)
            if name in _BLOCK:
                cut()
            continue
        if name == "head" and not closing:
            cut()
            in_head = True
            continue
        if name == "title" and in_head and not closing:  # without an end tag: its text goes up to the next tag
            cut()
            lt = page.find("<", at)
            at = lt if lt >= 0 else end
            continue
        if name in _BLOCK and name != "html":
            in_head = False
        if name == "a":
            in_link = not closing
        elif name == "br":
            run.append(" ")
        elif name in _BLOCK:
            cut()
            if name in _HOLDERS:
                if closing:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            in_link = False
                            break
                else:
                    aside, main = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
                    named = _named(tag[5]) if tag[5] else ""
                    if name == "li" and stack and stack[-1][0] == "li":
                        stack.pop()
                        aside, main = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
                    if name == "main":
                        aside = 0
                    if name in ("article", "main") or named and name in ("div", "section") and _MAIN.search(named):
                        main, has_main = 1, 1
                    if name in ("nav", "footer", "aside", "form", "menu", "dialog", "fieldset") or (name == "header" or "header" in named.lower()) and not main or named and name not in ("html", "body", "article", "main") and _ASIDE.search(named) or tag[5] and _HIDDEN.search(tag[5]):
                        aside = 1
                    stack.append((name, aside, main))
                state[:2] = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
                state[2] = name if name == "li" and not closing else ""
            elif closing:
                state[:] = [*((stack[-1][1], stack[-1][2]) if stack else (0, 0)), ""]
            else:
                aside, main = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
                if tag[5]:
                    named = _named(tag[5])
                    if named and _ASIDE.search(named) or _HIDDEN.search(tag[5]):
                        aside = 1
                state[:] = [aside, main, name if name in _TEXT_HOLDERS else ""]
    cut()
    for i, r in enumerate(rows):
        r[8] = has_main
        if i:
            r[2], r[3] = rows[i - 1][:2]
            rows[i - 1][4], rows[i - 1][5] = r[:2]
    return texts, rows


def labelled_blocks(seed: int = 1, pages: int = 1600, opaque: float = 0.07) -> tuple[list[list[float]], list[int]]:
    """The labelled table: FEATURES and 1 (main text) or 0 of the blocks of layouts whose parts are known. opaque: the share of side parts whose class name says nothing."""
    r = random.Random(seed)
    X, y = [], []
    for p in range(pages):
        labels: dict[str, int] = {}

        def words(n: int, keep: int) -> str:
            text = f"w{len(labels)}" + "".join(f" {''.join(r.choices('aeioulnrst', k=r.randint(2, 9)))}" for _ in range(max(0, n - 1)))
            labels[text] = keep
            return text

        def link(n: int, keep: int) -> str:
            return f'<a href="/{r.randint(1, 99)}">{words(n, keep)}</a>'

        def menu() -> str:
            links = [link(r.randint(1, 3), 0) for _ in range(r.randint(3, 8))]
            kind = r.random()
            if kind < 0.5:
                return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
            if kind < 0.7:
                return "<table><tr>" + "".join(f"<td>{x}</td>" for x in links) + "</tr></table>"
            return "".join(f"<{t}>{x}</{t}>" for t in (r.choice(("div", "p")),) for x in links)

        def dull(name: str, low: int = 2, high: int = 30) -> str:
            tag = r.choice(("div", "section"))
            name = name if r.random() >= opaque else f"c{r.randint(1, 99)}"
            inner = "".join(f"<p>{words(min(high, max(low, int(r.lognormvariate(2.4, 0.9)))), 0)}</p>" for _ in range(r.randint(1, 4)))
            return f'<{tag} class="{name}">{inner}</{tag}>'

        def story(held: str) -> str:
            out = [f"<h1>{words(r.randint(2, 12), 1)}</h1>"]
            for _ in range(r.randint(1, 10)):
                kind = r.random()
                if kind < 0.65:
                    text = words(min(400, max(1, int(r.lognormvariate(3.0, 1.1)))), 1)
                    out.append(f"<p>{text}</p>")
                elif kind < 0.75:
                    out.append(f"<h2>{words(r.randint(1, 7), 1)}</h2>")
                elif kind < 0.85:
                    out.append("<ul>" + "".join(f"<li>{words(r.randint(1, 15), 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
                elif kind < 0.92:
                    out.append(f"<blockquote>{words(r.randint(5, 40), 1)}</blockquote>")
                elif r.random() < 0.5:
                    out.append(f'<div class="{r.choice(("ad", "promo", "related", "share"))}">{words(r.randint(2, 20), 0)}</div>')
                else:
                    out.append(f"<p>{link(r.randint(1, 4), 1)}</p>" if r.random() < 0.3 and held in ("article", "main") else f"<p>{words(r.randint(8, 50), 1)}</p>")
            return "".join(out)

        held = r.choice(("article", "article", "main", 'div class="content"', 'div id="post-body"', "div", "", ""))
        body = story(held)
        body = f"<{held}>{body}</{held.split()[0]}>" if held else body
        before = [f"<nav>{menu()}</nav>" if r.random() < 0.6 else (f'<div class="menu">{menu()}</div>' if r.random() < 0.5 else menu())]
        if r.random() < 0.5:
            before.insert(0, f"<header><p>{words(r.randint(1, 12), 0)}</p></header>")
        for name in ("cookie-notice", "ad", "sidebar", "breadcrumbs"):
            if r.random() < 0.35:
                before.append(dull(name))
        if r.random() < 0.3:
            before.append(f"<aside><p>{words(r.randint(3, 60), 0)}</p></aside>")
        after = []
        if r.random() < 0.5:
            after.append(dull(r.choice(("comments", "comment-list", "reply")), 2, 200))
        if r.random() < 0.4:
            after.append(f"<form><p>{words(r.randint(1, 20), 0)}</p></form>")
        if r.random() < 0.4:
            after.append(f"<aside>{menu()}</aside>" if r.random() < 0.5 else dull("related-posts"))
        if r.random() < 0.25:  # nothing around the text
            before, after = before[: r.random() < 0.5], []
        else:
            after.append(f"<footer>{words(r.randint(2, 25), 0)}</footer>" if r.random() < 0.7 else f'<div id="footer">{words(r.randint(2, 25), 0)}</div>')
        texts, rows = blocks(f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>")
        X += rows
        y += [labels[t] for t in texts]
    return X, y


def _split(X, y, at, features, least: int):
    """(cost, feature, threshold) of the split of rows `at` with the least Gini impurity, sides of `least` rows at least; None without one."""
    import numpy as np

    n, ones, best = len(at), y[at].sum(), None
    for f in features:
        order = at[np.argsort(X[at, f], kind="stable")]
        v, c = X[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        k = k[(k >= least) & (k <= n - least)]
        if len(k):
            a, b = c[k - 1], ones - c[k - 1]
            cost = a * (k - a) / k + b * (n - k - b) / (n - k)
            i = int(np.argmin(cost))
            if best is None or cost[i] < best[0]:
                best = (cost[i], f, (v[k[i] - 1] + v[k[i]]) / 2)
    return best


def grow(X, y, depth: int = 12, least: int = 8, textual: int = 4, broad: float = 0.005):
    """A decision tree by Gini impurity: (feature, threshold, tree if <=, tree if >) or the leaf's class.

    Word counts and link densities, a block's own and its neighbours', ask in the first `textual` levels,
    where a side holds `broad` of all rows at least, so no leaf hangs on a few odd lengths. What they
    can't tell apart, what encloses a block does.
    """
    import numpy as np

    X, y = np.asarray(X, float), np.asarray(y, float)

    def node(at, left: int):
        n, ones = len(at), y[at].sum()
        if not left or n < 2 * least or ones in (0, n):
            return int(2 * ones >= n)
        now = ones * (n - ones) / n
        best = _split(X, y, at, range(TEXTUAL), max(least, int(broad * len(y)))) if left > depth - textual else None
        if best is None or best[0] >= now - 1e-9:
            best = _split(X, y, at, range(X.shape[1]), least)
        if best is None or best[0] >= now - 1e-9:
            return int(2 * ones >= n)
        low = X[at, best[1]] <= best[2]
        return (best[1], float(best[2]), node(at[low], left - 1), node(at[~low], left - 1))

    return node(np.arange(len(y)), depth)


def decided_by_text(tree, row) -> bool:
    """Does the tree judge a block by words and link densities alone."""
    while tree.__class__ is tuple:
        if tree[0] >= TEXTUAL:
            return False
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return True


def kept(tree, row) -> int:
    while tree.__class__ is tuple:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree) -> str:
    texts, rows = blocks(page)
    return "\n\n".join(t for t, row in zip(texts, rows) if kept(tree, row))


def _extract(keep: list[str], tree):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [main_text(h.as_py() or "", tree) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*keep, "text", "n_chars"])

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), seed: int = 1) -> DataFrame:
    """The kept columns of pages with text (blocks kept, joined by an empty line) and n_chars (code points).

    A null or empty html has an empty text. Repeated rows are kept. No pages give no rows. Nothing is cut off or capped. Kept
    columns named text or n_chars are replaced.
    """
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    tree = grow(*labelled_blocks(seed))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema), "text string, n_chars long"])
    return pages.select(*dict.fromkeys([*keep, "html"])).mapInArrow(lean(_extract(list(keep), tree)), schema)


def op8_block_tree(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
