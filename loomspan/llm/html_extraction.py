"""Main text of web pages by equivalence-class template deduction.

Pages of one host mostly come from one template. Tokens (tags in their place, and
whole text blocks) whose counts over the host's pages are the same vector form an
equivalence class. A class is valid if its tokens keep one order on all pages. Valid
classes nest into the host's template: a class lies in a gap of another, behind the
same token on every page; what follows a nested class is in the gap around it again.
The text that pages have in a gap fills the slot there. The content slots are the
one with most text, those with a tenth of that or more, headings that lead to them,
and what lies in the same element as they do. Texts of the template itself fill no
slot. Element names and marks (menus, adverts, forms and the like) only take slots
out of the choice, and widen the chosen element to an article around it.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MIN_SUPPORT = 0.5  # of a host's pages, for a token of the template
MIN_PAGES = 3  # with fewer pages a host has no template of its own
SALTS = 32  # parts of one host's pages
MOST_BROADCAST = 32 << 20  # bytes of templates
MIN_PATH = 0.001  # of a host's text, for an element path to count in the choice of slots
MIN_SLOT = 0.1  # of the fullest slot's text, for a content slot
# A text block inside the content element counts as template if it stands on that share of a host's pages, the host has
# so many, and that share of the pages with it differ; else an article may well repeat what others have.
CONSTANT, CONSTANT_PAGES, DIFFERING = 0.9, 10, 0.5
# HTML elements by their part in a page, and words in class, id and role that mark what is not the article.
BLOCKS = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FRAMES = set("html head body header footer nav aside main article section div form ul ol dl table fieldset figure dialog menu details hgroup search".split())
DROPPED = set("head title script style noscript template iframe object svg math canvas audio video select textarea button input option form fieldset nav aside footer menu dialog search label".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
MARKS = set("ad ads adv advert advertisement advertising adsense sponsor sponsored promo promoted promotion banner sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert comment comments commentlist disqus reply replies respond newsletter subscribe subscription signup login share sharing social related recommended recommendations popup modal overlay pagination pager search widget skip hidden".split())
HEADS = {"header", "hgroup"}
HEADINGS = {"h1", "h2", "h3"}
NAMED = {"article", "main"}

# quotes count behind an equals sign only: a stray apostrophe in a tag is a character like others
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S)
_FORM = re.compile(r"<(/?)form\b|<(?:article|main|h1)\b", re.I)
_NUMBER, _LONG_NUMBER = re.compile(r"\d+"), re.compile(r"\d{3,}")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marks(attrs: str) -> tuple[str, bool]:
    """(class and id, whether they or the role or a hiding attribute mark the element as no article)."""
    if not attrs or attrs == "/":
        return "", False
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
    # ids of single pages must not make the same place of a template look different
    name = ".".join(x for x in (_NUMBER.sub("0", found.get("id", "")), _LONG_NUMBER.sub("0", found.get("class", ""))) if x)
    words = set(_SPLIT.split(" ".join(_CAMEL.sub(" ", found.get(k, "")) for k in ("id", "class", "role", "itemprop")).lower()))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    return name, hidden or bool(words & MARKS) or found.get("role", "") in {"complementary", "contentinfo", "banner", "form"}


def _wrappers(page: str) -> bool:
    """Whether a form of the page holds an article, main element or first heading: it wraps the page and is no form to fill in."""
    depth = 0
    for m in _FORM.finditer(page):
        if m[1] is None:
            if depth:
                return True
        else:
            depth = max(0, depth + (-1 if m[1] else 1))
    return False


def tokens(page: str | None) -> Iterator[tuple[str, str, bool, str]]:
    """A page as (kind, path, dropped, payload).

    kind "tag": payload is the tag in its place (opening or closing, with class and
    id, in which the numbers of ids and long ones count as equal); kind "text" or "heading": payload is a block's
    text, references decoded, white space made one space, trimmed. path names the
    open framing elements, dropped tells whether the place is no article by its
    elements or marks. Broken markup is read leniently: end tags close what stands
    open inside, stray ones are passed."""
    if not page:
        return
    open_: list[tuple[str, str, bool]] = []  # element, path, dropped
    parts: list[str] = []
    at, n, heading = 0, len(page), False
    dropping = DROPPED - {"form"} if "<form" in page.lower() and _wrappers(page) else DROPPED

    def flush() -> str:
        text = " ".join(_html.unescape("".join(parts)).split())
        parts.clear()
        return text

    def here() -> tuple[str, bool]:
        return (open_[-1][1], open_[-1][2]) if open_ else ("", False)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if not m[1]:
            continue
        name, closing = m[1].lower(), page[m.start() + 1] == "/"
        if name in BLOCKS or name in dropping:
            if text := flush():
                yield ("heading" if heading else "text", *here(), text)
            heading = name in HEADINGS and not closing
        if name in RAW and not closing:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            yield ("tag", f"{here()[0]}/{name}", True, name)
            at = end.end() if end else n
            continue
        if name not in FRAMES and name not in dropping:
            if name in BLOCKS:
                yield ("tag", here()[0], here()[1], ("/" if closing else "") + name)
            continue
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    yield ("tag", here()[0], here()[1], "/" + name)
                    break
            continue
        path, dropped = here()
        mark, marked = _marks(m[2])
        inside = any(e in ("article", "main") for e, _, _ in open_)
        gone = dropped or marked or name in dropping or name in HEADS and not inside
        if name in ("html", "body", "main", "article"):
            gone = dropped
        path = f"{path}/{name}" + (f".{mark}" if mark and name not in ("html", "body") else "")
        yield ("tag", path, gone, name)
        if name not in VOID:
            open_.append((name, path, gone))
    if text := flush():
        yield ("heading" if heading else "text", *here(), text)


def _code(*parts: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _coded(page: str | None) -> Iterator[tuple[int, str, str, bool, str]]:
    """(code, kind, path, dropped, payload); headings are texts to the template."""
    for kind, path, dropped, payload in tokens(page):
        yield _code("tag" if kind == "tag" else "text", path, payload), kind, path, dropped, payload


SIGNS = "codes array<long>, counts array<int>, texts array<boolean>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its tokens in order of first place, with their counts and whether they are texts."""
    for batch in batches:
        codes, counts, texts = [], [], []
        for page in batch.column("html").to_pylist():
            seen: dict[int, int] = {}
            text: dict[int, bool] = {}
            for code, kind, _, _, _ in _coded(page):
                seen[code] = seen.get(code, 0) + 1
                text[code] = kind != "tag"
            codes.append(list(seen)), counts.append(list(seen.values())), texts.append(list(text.values()))
        arrays = [pa.array(codes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("host"), *arrays], names=["page", "host", "codes", "counts", "texts"])


def host_of(url):
    """Lower-case host of a URL column; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def classes(signs: DataFrame, min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, code, class, place, support, constant): the tokens of each host's valid classes.

    Occurrence vectors are compared by a sum of hashes of (page, count), which
    combines before the shuffle, so a host of any size is never gathered. Tokens on
    fewer than half of the host's pages are in no class."""
    hosts = signs.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    whole = F.xxhash64("codes")
    each = signs.select("host", "page", whole.alias("whole"), F.posexplode(F.arrays_zip("codes", "counts", "texts")).alias("at", "t"))
    each = each.select("host", "page", "whole", "at", F.col("t.codes").alias("code"), F.col("t.counts").alias("n"), F.col("t.texts").alias("text"))
    share = F.xxhash64("page", "n").cast("decimal(20,0)")
    found = each.groupBy("host", "code").agg(
        F.count("*").alias("support"), F.sum(share).alias("vector"), F.avg("at").alias("place"), F.bool_or("text").alias("text"),
        F.approx_count_distinct("whole").alias("kinds"),
    )
    found = found.join(hosts, "host").where(F.col("support") >= F.greatest(F.lit(2.0), min_support * F.col("pages")))
    constant = F.col("text") & (F.col("pages") >= CONSTANT_PAGES) & (F.col("support") >= CONSTANT * F.col("pages")) & (F.col("kinds") >= DIFFERING * F.col("support"))
    found = found.select("host", "code", "place", "support", "text", constant.alias("constant"), F.xxhash64("support", "vector").alias("class"))
    # validity: on every page the class's tokens come in the same order
    rows = each.select("host", "page", "at", "code").join(found.select("host", "code", "class"), ["host", "code"])
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])
    order = rows.groupBy("host", "page", "class").agg(F.xxhash64(in_order).alias("order"))
    valid = order.groupBy("host", "class").agg(F.min("order").alias("lo"), F.max("order").alias("hi")).where("lo = hi").select("host", "class")
    return found.join(valid, ["host", "class"], "left_semi")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages against their host's classes: rows (host, code, class, parent, path, mass, heads).

    With class: on this page the class begins behind the token parent, the nearest
    before it of a class on more pages. With path: behind the token code stands so
    much text that the template doesn't hold, below the element path, heads of it in headings."""
    for batch in batches:
        out: dict[tuple, list[int]] = {}
        for page, host, codes, kinds, supports in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "codes", "classes", "supports"))):
            if codes is None:
                continue
            known = {c: (k, s) for c, k, s in zip(codes, kinds, supports)}
            last, seen, trail = 0, set(), []
            for code, kind, path, dropped, payload in _coded(page):
                if code in known:
                    cls, support = known[code]
                    if cls not in seen:
                        seen.add(cls)
                        parent = next((c for c, s in reversed(trail) if s > support), 0)
                        out.setdefault((host, 0, cls, parent, None), [0, 0])
                    trail.append((code, support))
                    last = code
                elif kind != "tag" and not dropped:
                    sums = out.setdefault((host, last, 0, 0, path), [0, 0])
                    sums[0] += len(payload)
                    sums[1] += len(payload) * (kind == "heading")
        rows = list(out)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        keys = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        sums = [pa.array([out[r][i] for r in rows], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*keys, *sums], names=["host", "code", "class", "parent", "path", "mass", "heads"])


SLOTS = "host string, code long, class long, parent long, path string, mass long, heads long"
PLAN = "host string, codes array<long>, gaps array<long>, texts array<boolean>, constants array<boolean>, content array<long>, region string"


def nest(tokens_: list[tuple[int, int]], parents: dict[int, set[int]]) -> dict[int, int]:
    """The gap behind each template token, named by the token that opens it, from (code, class) in order and the tokens behind which each class begins.

    Behind the last token of a class that always lies in one gap of another, that gap goes on."""
    own, last = dict(tokens_), {}
    for code, cls in tokens_:
        last[cls] = code
    gaps: dict[int, int] = {}

    def gap(code: int, depth: int = 0) -> int:
        if code not in gaps:
            around = parents.get(own[code], set())
            outer = next(iter(around)) if len(around) == 1 else 0
            nested = last[own[code]] == code and outer in own and depth < len(own)
            gaps[code] = gap(outer, depth + 1) if nested else code
        return gaps[code]

    return {code: gap(code) for code, _ in tokens_}


def _inside(path: str, region: str) -> bool:
    return path == region or path.startswith(region + "/")


def _element(path: str) -> str:
    return path.rpartition("/")[2].split(".")[0]


def _common(paths: list[str]) -> str:
    """The deepest element above or at all paths; "" for the body or none."""
    parts = [p.split("/") for p in paths]
    same = []
    for step in zip(*parts):
        if len(set(step)) > 1:
            break
        same.append(step[0])
    path = "/".join(same)
    return "" if _element(path) in ("", "html", "body") else path


def choose(order: list[int], slots: dict[int, dict[str, list[int]]]) -> tuple[list[int], str]:
    """(content slots, the element that holds them, "" for none) from the slots in template order and the text and heading text of each by path."""
    mass = {s: sum(m for m, _ in slots[s].values()) for s in order if s in slots}
    most = max(mass.values(), default=0)
    if not most:
        return [], ""
    chosen = [s for s in order if mass.get(s, 0) >= MIN_SLOT * most]
    # a place holds the slots if it has most of each one's text: few stray blocks don't widen it
    wide = lambda s: [p for p, (m, _) in slots[s].items() if m >= MIN_SLOT * mass[s]]
    region = _common([p for s in chosen for p in wide(s)])
    ahead = order[: order.index(chosen[0])]
    heads = [s for s in ahead if s in slots and sum(h for _, h in slots[s].values()) >= 0.5 * mass[s] > 0][-1:]
    if heads:
        chosen = heads + chosen
        region = _common([p for s in chosen for p in wide(s)]) if region else ""
    steps = region.split("/")
    for k in range(len(steps), 0, -1):  # an article around them is theirs as a whole
        if steps[k - 1].split(".")[0] in NAMED:
            return chosen, "/".join(steps[:k])
    return chosen, region


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One host's template: as many rows as it has tokens and slots, whatever the number of its pages."""
    tokens_ = pdf[pdf["kind"] == "token"].sort_values(["place", "code"])
    parents: dict[int, set[int]] = {}
    for cls, parent in pdf[pdf["kind"] == "begin"][["class", "parent"]].itertuples(index=False):
        parents.setdefault(int(cls), set()).add(int(parent))
    order = [(int(c), int(k)) for c, k in zip(tokens_["code"], tokens_["class"])]
    gaps = nest(order, parents)
    gaps[0] = 0
    slots: dict[int, dict[str, list[int]]] = {}
    for code, path, mass, heads in pdf[pdf["kind"] == "slot"][["code", "path", "mass", "heads"]].itertuples(index=False):
        at = slots.setdefault(gaps[int(code)], {}).setdefault(path, [0, 0])
        at[0] += int(mass)
        at[1] += int(heads)
    content, region = choose(list(dict.fromkeys([0, *(gaps[c] for c, _ in order)])), slots)
    row = {"host": pdf["host"].iloc[0], "codes": [c for c, _ in order], "gaps": [gaps[c] for c, _ in order], "texts": tokens_["text"].astype(bool).tolist(), "constants": tokens_["constant"].astype(bool).tolist(), "content": content, "region": region}
    return pd.DataFrame([row])


def _own_region(found: list[tuple]) -> str:
    """The path of the page's own articles, else of its main element, else the one with all of its text."""
    for name in ("article", "main"):
        paths = [path for _, kind, path, dropped, payload in found if kind == "tag" and payload == name and not dropped]
        if paths:
            return paths[0]
    return ""


def _extract(page: str | None, plan: dict | None) -> str:
    """The text of the page's content slots, and of all that lies in the element which holds them."""
    found = list(_coded(page))
    region = plan["region"] if plan else ""
    known = plan["known"] if plan else {}
    met = plan and any(kind == "tag" and code in known for code, kind, _, _, _ in found)
    if not met or region and not any(path == region for _, kind, path, _, _ in found if kind == "tag"):
        # a page that isn't made by its host's template, or a host without one
        region, known, plan = _own_region(found), {}, None
    out, last = [], 0
    for code, kind, path, dropped, payload in found:
        if kind != "tag" and not dropped:
            if region and _inside(path, region):
                # here a block of the template is left out only where it surely is none of the article's
                if not (code in known and known[code][2]):
                    out.append(payload)
            elif plan is None:
                if not region:
                    out.append(payload)
            elif code not in known and last in plan["content"]:
                out.append(payload)
        if code in known:
            last = known[code][0]
    return "\n".join(out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans: dict = {None: None}
        texts = []
        for page, host, codes, gaps, is_text, constants, content, region in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "codes", "gaps", "texts", "constants", "content", "region"))):
            if host not in plans:
                # where all pages are copies no slot has text, and the template tells nothing
                plans[host] = content and {"known": {c: (g, t, k) for c, g, t, k in zip(codes, gaps, is_text, constants)}, "content": set(content), "region": region}
            texts.append(_extract(page, plans[host]))
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])


def _with_templates(rows: DataFrame, found: DataFrame, most_broadcast: int) -> DataFrame:
    """rows with their host's row of found: by broadcast if its measured size allows, else a host's pages in many parts, each with that row."""
    arrays = [F.coalesce(F.sum(F.size(c)), F.lit(0)) for c, t in found.dtypes if t.startswith("array")]
    size = found.agg(F.count("*") * 64 + sum(arrays) * 8 + F.coalesce(F.sum(F.length("host")), F.lit(0))).first()[0]
    if size <= most_broadcast:
        return rows.join(F.broadcast(found), "host", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left").drop("salt")


def templates(rows: DataFrame, min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(host, codes, gaps, texts, constants, content, region) from rows (page_id, url, html, host): each host's template and where its content stands."""
    page = F.xxhash64("page_id", "url", F.crc32(F.coalesce(F.col("html"), F.lit("")).cast("binary"))).alias("page")
    named = rows.where("host is not null")
    signs = cut(named.select(page, "host", "html").mapInArrow(_signatures, f"page long, host string, {SIGNS}"))
    found = cut(classes(signs, min_support, min_pages))
    lists = found.groupBy("host").agg(F.collect_list("code").alias("codes"), F.collect_list("class").alias("classes"), F.collect_list("support").alias("supports"))
    slots = _with_templates(named, cut(lists), most_broadcast).where("codes is not null").select("html", "host", "codes", "classes", "supports").mapInArrow(_slots, SLOTS)
    slots = cut(slots.groupBy("host", "code", "class", "parent", "path").agg(F.sum("mass").alias("mass"), F.sum("heads").alias("heads")))
    filled = slots.where("path is not null")
    total = filled.groupBy("host").agg(F.sum("mass").alias("total"))
    filled = filled.join(total, "host").where(F.col("mass") >= MIN_PATH * F.col("total")).drop("total")
    begins = slots.where("path is null").groupBy("host", "class").agg(F.min("parent").alias("lo"), F.max("parent").alias("hi"))
    begins = begins.select("host", "class", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("parent"))
    both = found.withColumn("kind", F.lit("token")).unionByName(filled.withColumn("kind", F.lit("slot")), allowMissingColumns=True)
    both = both.unionByName(begins.withColumn("kind", F.lit("begin")), allowMissingColumns=True).fillna(0, ["code", "class", "parent", "mass", "heads"])
    # a host's template tokens, its classes and at most 1 / MIN_PATH paths, not its pages
    return cut(both.groupBy("host").applyInPandas(_plan, PLAN))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    The templates go to the pages by broadcast if their measured size is at most
    most_broadcast bytes, so html isn't shuffled; beyond, by a salted join.

    text is the main text: blocks in page order joined by a line feed, "" for null
    or empty html. Hosts with under 3 pages, and null URLs, have no template; their
    pages, and those on which nothing of the template stands, are read by their own
    articles or main element, else by all that isn't marked as something else.
    Slots with equal text go by template order. Repeated rows stay; very long pages
    are read whole; other columns are not read; an empty table gives an empty one."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = _with_templates(rows, templates(rows, most_broadcast=most_broadcast), most_broadcast)
    joined = joined.select("page_id", "url", "html", "host", "codes", "gaps", "texts", "constants", "content", "region")
    id_type = dict(pages.dtypes)[id_col]
    return joined.mapInArrow(_texts, f"page_id {id_type}, url string, text string, n_chars long")
