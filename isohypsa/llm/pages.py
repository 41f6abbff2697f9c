"""Main text of web pages by templates deduced from the pages of a host.

A page is a sequence of tokens: tags, told apart by the path of enclosing elements, and blocks of text with their path.
Tokens of a host with the same occurrence vector (how often on each page) form an equivalence class; vectors are compared by
a fingerprint that pages add to one by one, so pages of a host never meet in one task. A class is valid if one of its tokens stands on most pages with the tag around it, and then
holds for all its tokens; a class is nested in that of the element that encloses its tokens, and the nested classes are the host's template. What lies between template tokens are slots.
A page's text is what its slots hold, without those of menus, adverts and the like: slots inside elements that say so, slots
of the template that hold mostly links, and blocks that belong to the template themselves. Where a page marks its article, the slots in that
element go before others.

A page is told by its host and a hash of its source; copies are judged once. Its markup is read where it lies: what moves are hashes of its tokens and, at the end, the text of its slots.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohypsa.staging import stage

#: A class is valid on this share of a host's pages, at least so many; a slot holds mostly links from this share of its characters.
SHARE, LEAST_PAGES, LINKS = 0.6, 3, 0.5
#: A host with more than this part of all pages meets its template in several tasks, one for each such part that it has.
SALTED = 500
#: Elements without an end, whose content is no text, that bound blocks, and that never hold the main text (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title noembed noframes".split())
#: Elements whose content is no text of the page; without an end they hold nothing.
DROPPED = frozenset("template noscript svg canvas object audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split())
OUTSIDE = frozenset("head nav aside footer form button select menu dialog fieldset option datalist".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Elements that a new block ends if they are still open.
IMPLIED = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
           "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "head": frozenset(["body"])}
#: Words of class and id names that mark what is no main text (fixed values).
NAMES = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|cookies?|consent|gdpr|notice|"
    r"popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommend\w*|comments?|replies|respond|disqus|login|search|widget|toolbar|"
    r"pagination|pager|skip|disclaimer|copyright|tags?|hidden)(?:$|[\s_-])", re.I)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(comments?|reply|replies|ads?|advert\w*|promo\w*|related)(?=$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
TOKEN = re.compile(r"""(?s)<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""")


@dataclass(slots=True)
class Run:
    """Text between two tags: its path, whether it lies outside of what can be main text, in a link, in an article or main element;
    the enclosing elements with names of what is no main text, and the outermost article or main element, by their numbers."""

    text: str
    path: str
    outside: bool
    link: bool
    article: bool
    main: bool
    block: int
    named: tuple[int, ...] = ()
    marked: int = -1


@dataclass(slots=True)
class Page:
    runs: list[Run] = field(default_factory=list)
    tags: dict[str, list[int]] = field(default_factory=dict)  # path: number, place of the first
    parents: dict[str, str] = field(default_factory=dict)  # path: that of the enclosing element


def element(path: str) -> str:
    """The tag that begins at a path: elements whose role makes them main have a mark of their own."""
    return path.removesuffix("[div]")


def short_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def run_key(path: str, text: str) -> int:
    """A short name of a block at its path."""
    return short_hash(f"{path}#{text}")


def slot_key(path: str) -> int:
    return short_hash(f"{path}#")


def host_of(url: str | None) -> str | None:
    m = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@\s]*@)?([^/?#:\s]+)", url or "")
    return m[1].lower() if m else None


def parse(source: str | None) -> Page:
    """Tokens of one page. Broken markup is read on: an end without a start is dropped, an element without an end lasts to that of its parent."""
    page, at, block, link = Page(), 0, 0, 0
    source = source or ""
    stack: list[tuple[str, bool, str, int, int]] = []  # name, whether outside begins here, path with it, number, number if its names tell so
    groups: dict[int, tuple[str, str]] = {}  # of an element with such a name: the word and the path around it
    number, endless = 0, set()

    def text(s: str) -> None:
        if s:
            names = [x[0] for x in stack]
            page.runs.append(Run(s, stack[-1][2] if stack else "", any(x[1] for x in stack), link > 0, "article" in names, "main" in names, block,
                                 tuple(x[4] for x in stack if x[4]), next((x[3] for x in stack if x[0] in ("article", "main")), -1)))

    while m := TOKEN.search(source, at):
        text(source[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            block += 1
        if m[1] or m[4]:
            if name == "a":
                link = max(0, link - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name or stack[i][0] == "main" and name == "div" and stack[i][2].endswith("[div]"):
                    del stack[i:]
                    break
            if name == "br":
                text(" ")
            continue
        if name == "br":
            text(" ")
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3] if m[2] else m[6])} if (m[3] if m[2] else m[6]) else {}
        if name in RAW or name == "xmp":
            end = re.compile(rf"(?i)</{name}\s*>").search(source, at)
            if name == "xmp":  # its text is no markup
                text(source[at:end.start() if end else len(source)].replace("&", "&amp;"))
            at = end.end() if end else len(source)
            continue
        if name in DROPPED:
            if name not in endless and not re.compile(rf"(?i)</{name}[\s>]").search(source, at):
                endless.add(name)
            if name in endless or (m[3] if m[2] else m[6]).rstrip().endswith("/"):
                continue
        while stack and name in IMPLIED.get(stack[-1][0], ()):
            stack.pop()
        mark = " ".join(filter(None, (attributes.get("class"), attributes.get("id")))).replace("/", "|")
        path = (stack[-1][2] if stack else "") + "/" + name + (f".{re.sub('[0-9]+', '#', mark)}" if mark else "")
        seen = page.tags.setdefault(path, [0, len(page.tags)])
        seen[0] += 1
        page.parents.setdefault(path, element(stack[-1][2]) if stack else "")
        if name in VOID:
            continue
        if name == "a":
            link += 1
        inside = any(x[0] in ("article", "main") for x in stack)
        outside = (name in OUTSIDE or name in DROPPED or attributes.get("role", "").lower() in OUTSIDE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
                   or "display:none" in attributes.get("style", "").replace(" ", "").lower() or name == "header" and not inside)
        word = (ARTICLE_NAMES if name == "article" else NAMES).search(mark) if mark and name not in ("html", "body", "main") else None
        number += 1
        if word:
            groups[number] = (word[1].lower(), stack[-1][2] if stack else "")
        if name in BLOCK or name in ("a", "label", "summary") or outside or word:
            kind = "main" if attributes.get("role", "").lower() == "main" else name
            if name != "a" or outside or word:
                stack.append((kind, outside, path + ("[div]" if kind != name else ""), number, number if word else 0))
    text(source[at:])
    leave_out_named(page.runs, groups)
    return page


def leave_out_named(runs: list[Run], groups: dict[int, tuple[str, str]]) -> None:
    """Runs in elements with names of what is no main text are outside, but not by an element that alone or else together with its like (same word,
    same path around it) holds most of the page's text, nor by one around the page's longest article if every article stands in such an element."""
    if not groups:
        return
    total, held, article, clean = 0, Counter(), Counter(), False
    around: dict[int, set[int]] = {}
    for r in runs:
        n = 0 if r.outside else len("".join(r.text.split()))
        if not n:
            continue
        total += n
        held.update({g: n for g in {groups[k] for k in r.named} | set(r.named)})
        if r.marked >= 0:
            article[r.marked] += n
            around[r.marked] = around.get(r.marked, set(r.named)) & set(r.named)
            clean = clean or not r.named
    spared = {k for k in groups if 2 * held[k] > total}
    alone = {groups[k] for k in spared}
    spared |= {k for k, g in groups.items() if g not in alone and 2 * held[g] > total}
    if article and not clean:
        spared |= around[max(article, key=lambda k: article[k])]
    for r in runs:
        r.outside = r.outside or any(k not in spared for k in r.named)


def blocks(runs: list[Run]) -> list[tuple[str, str]]:
    """Path and decoded text of every block that has text: white space inside it is one space."""
    out: dict[int, list[Run]] = {}
    for r in runs:
        out.setdefault(r.block, []).append(r)
    done = ((parts[0].path, " ".join(html.unescape("".join(r.text for r in parts)).split())) for parts in out.values())
    return [(p, t) for p, t in done if t]


def main_text(page: Page, link_slots: frozenset[int] = frozenset(), constant: frozenset[int] = frozenset()) -> str:
    """The text of the page's main slots, blocks joined by a line end. link_slots and constant are what the host's template says: paths (their slot_key) that
    hold mostly links, and blocks (their run_key) of the template itself. Of the slots that are left, those in an article or else a main element
    count if there are any. Where the template leaves nothing of a page, its article, main element or whole text stays as it is."""
    inner = [r for r in page.runs if not r.outside]
    links = {p for p in {r.path for r in inner} if slot_key(p) in link_slots} if link_slots else ()
    slots = [r for r in inner if r.path not in links]
    for runs, known in ((slots, constant), (inner, frozenset())):
        for marked in ([r for r in runs if r.article], [r for r in runs if r.main], runs):
            if found := [t for p, t in blocks(marked) if not known or run_key(p, t) not in known]:
                return "\n".join(found)
    return ""


def source_key(source: str) -> int:
    return short_hash(source)


def tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """host, page and its tokens: tags (path, how often, place of the first), slots (path, their characters and those in links) and blocks (hash, slot that
    holds it, how often). Pages without a host or source have none."""
    for b in batches:
        out = []
        for url, source in zip(b["url"], b["html"]):
            host = host_of(url)
            if host is None or not source:
                continue
            page = parse(source)
            slots: dict[str, list[int]] = {}
            free = [r for r in page.runs if not r.outside]
            for r in free:
                s = slots.setdefault(r.path, [0, 0])
                n = len("".join(r.text.split()))
                s[0] += n
                s[1] += n * r.link
            held = [(p, c, k) for p, (c, k) in slots.items() if c]
            at = {p: i for i, (p, _, _) in enumerate(held)}
            runs: dict[int, list[int]] = {}
            for p, t in blocks(free):
                runs.setdefault(run_key(p, t), [at.get(p, -1), 0])[1] += 1
            out.append((host, source_key(source), [(p, n, i) for p, (n, i) in page.tags.items()], held, [(h, i, n) for h, (i, n) in runs.items()]))
        yield pd.DataFrame(out, columns=["host", "page", "tags", "slots", "runs"])


TOKENS = ("host string, page long, tags array<struct<token:string,n:int,place:int>>, slots array<struct<token:string,chars:long,linked:long>>, "
          "runs array<struct<hash:long,slot:int,n:int>>")


def distinct_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens of every page of a host that has another source, and host, page, n: how often each stands. Only pages whose source stands several times are moved to be
    told apart; which those are comes from the count."""
    each = stage(pages.select("url", "html").mapInPandas(tokens_of, TOKENS), "page-tokens")
    counts = stage(each.groupBy("host", "page").agg(F.count("*").alias("n")), "page-counts")
    again = stage(counts.filter("n > 1").select("host", "page"), "repeated-pages")
    copies = each.join(again, ["host", "page"], "left_semi").dropDuplicates(["host", "page"])
    return each.join(again, ["host", "page"], "left_anti").unionByName(copies), counts


def enclosing(token: Column) -> Column:
    """The path of the tag that encloses a tag."""
    return F.regexp_replace(F.regexp_replace(token, r"/[^/]*$", ""), r"\[div\]$", "")


def classes(pages: DataFrame) -> DataFrame:
    """host, token, kind, within, class, pages, support, place, chars, linked of every host's valid classes; a block's token is its hash in digits."""
    return valid_classes(distinct_pages(pages)[0])


def valid_classes(each: DataFrame) -> DataFrame:
    """Valid classes from the tokens of different pages. class is a fingerprint of
    the occurrence vector. pages counts the pages that hold the enclosing tag, so that a layout of some of a host's pages has classes
    of its own; support and pages count the same pages."""
    vector = F.bit_xor(F.xxhash64("page", "n")).alias("vector")
    none = F.lit(0).cast("long")
    tag = each.select("host", "page", F.explode(F.concat(F.array(F.struct(F.lit("").alias("token"), F.lit(1).alias("n"), F.lit(0).alias("place"))), "tags")).alias("t")).select("host", "page", "t.*")
    tag = tag.groupBy("host", "token").agg(vector, F.count("*").alias("support"), F.avg("place").alias("place"))
    tag = tag.select("host", "token", F.when(F.col("token") == "", "page").otherwise("tag").alias("kind"), F.when(F.col("token") != "", F.xxhash64(enclosing(F.col("token")))).alias("around"),
                     F.when(F.col("token") != "", enclosing(F.col("token"))).alias("within"), "vector", "support", "place", none.alias("chars"), none.alias("linked"))
    inner = lambda path: F.xxhash64(F.regexp_replace(path, r"\[div\]$", ""))
    slot = each.select("host", "page", F.explode("slots").alias("t"), F.lit(1).alias("n")).groupBy("host", F.col("t.token").alias("token")).agg(
        vector, F.count("*").alias("support"), F.sum("t.chars").alias("chars"), F.sum("t.linked").alias("linked"))
    slot = slot.select("host", "token", F.lit("slot").alias("kind"), inner(F.col("token")).alias("around"), F.regexp_replace("token", r"\[div\]$", "").alias("within"), "vector", "support", F.lit(0.0).alias("place"), "chars", "linked")
    paths = F.transform("slots", lambda x: inner(x["token"]))
    run = each.select("host", "page", paths.alias("paths"), F.explode("runs").alias("t")).select("host", "page", F.get("paths", F.col("t.slot")).alias("around"), "t.hash", "t.n")
    run = run.groupBy("host", "hash", "around").agg(vector, F.count("*").alias("support"))
    run = run.select("host", F.col("hash").cast("string").alias("token"), F.lit("run").alias("kind"), "around", F.lit(None).cast("string").alias("within"), "vector", "support", F.lit(0.0).alias("place"), none.alias("chars"), none.alias("linked"))
    token = stage(tag.unionByName(slot).unionByName(run).filter(F.col("support") >= LEAST_PAGES), "page-token-classes")  # what encloses a valid token has so many pages too
    holders = token.filter(F.col("kind").isin("page", "tag")).select("host", F.xxhash64("token").alias("around"), F.col("support").alias("pages")).groupBy("host", "around").agg(F.max("pages").alias("pages"))
    placed = token.filter("kind <> 'page'").join(holders, ["host", "around"]).withColumn("class", F.xxhash64("vector", "support"))
    valid = placed.groupBy("host", "class").agg(F.max(F.col("support") >= SHARE * F.col("pages")).alias("valid")).filter("valid")
    return placed.join(valid.select("host", "class"), ["host", "class"], "left_semi").select("host", "token", "kind", "within", "class", "pages", "support", "place", "chars", "linked")


def templates(pages: DataFrame) -> DataFrame:
    """host, place (of the token on the page, from 1), token, class, parent: the class of the nearest enclosing element that is in the template."""
    tags = classes(pages).filter("kind = 'tag'")
    outer = tags.select("host", F.col("token").alias("outer"), F.col("class").alias("parent"))
    order = Window.partitionBy("host").orderBy("place", "token")
    return tags.withColumnRenamed("within", "outer").join(outer, ["host", "outer"], "left").select("host", F.row_number().over(order).alias("place"), "token", "class", "parent")


def hot(counts: DataFrame, key: list[str], name: str) -> DataFrame:
    """key, salts of the keys that hold a SALTED-th of all rows or more: at most SALTED rows, and twice as many salts. counts: rows with n."""
    counts = counts.groupBy(*key).agg(F.sum("n").alias("n"))
    total = counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(1)), F.lit(1))).first()[0]
    return F.broadcast(stage(counts.filter(F.col("n") * SALTED >= total).select(*key, F.ceil(F.col("n") * SALTED / total).cast("long").alias("salts")), name))


def salted(rows: DataFrame, salts: DataFrame, key: list[str], by: Column | None) -> DataFrame:
    """rows with the salt of their key: one drawn from a column, or each of them."""
    joined = rows.join(salts, key, "left")
    n = F.coalesce("salts", F.lit(1).cast("long"))
    return joined.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)) if by is None else F.pmod(by, n)).drop("salts")


def told_pages(each: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """host, page, links (keys of slots) and fixed (keys of blocks): what the host's template says of the page's own tokens."""
    said = found.filter((F.col("kind") == "run") | (F.col("kind") == "slot") & (F.col("linked") >= LINKS * F.col("chars")))
    said = said.select("host", F.when(F.col("kind") == "run", F.col("token").cast("long")).otherwise(F.xxhash64("token")).alias("key"), F.col("kind").alias("kind"))
    mine = each.select("host", "page", F.explode(F.concat(
        F.transform("runs", lambda r: F.struct(r["hash"].alias("key"), F.lit("run").alias("kind"), F.lit(None).cast("string").alias("path"))),
        F.transform("slots", lambda x: F.struct(F.xxhash64(x["token"]).alias("key"), F.lit("slot").alias("kind"), x["token"].alias("path"))))).alias("t")).select("host", "page", "t.*")
    salts = hot(counts, ["host"], "hot-hosts")
    hit = salted(mine, salts, ["host"], F.col("page")).join(salted(said, salts, ["host"], None), ["host", "salt", "key", "kind"])
    return hit.groupBy("host", "page").agg(F.collect_set("path").alias("links"), F.collect_set(F.when(F.col("kind") == "run", F.col("key"))).alias("fixed"))


TEXTS = "page_id long, url string, host string, page long, paths array<string>, runs array<struct<path:int,block:int,marks:int,text:string>>"


def texts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """page_id, url, host, page and the text of the page's slots: runs with the place of their path, their block, and 1 for an article, 2 for a main element."""
    for b in batches:
        out = []
        for i, url, source in zip(b["page_id"], b["url"], b["html"]):
            paths: dict[str, int] = {}
            runs: list[list] = []
            for r in parse(source).runs:
                if not r.outside:
                    head = [paths.setdefault(r.path, len(paths)), r.block, r.article + 2 * r.main]
                    if runs and runs[-1][:3] == head:
                        runs[-1][3] += r.text
                    else:
                        runs.append([*head, r.text])
            host = host_of(url)
            runs = [r if len(r[3]) < 2 or not r[3].isspace() else [*r[:3], " "] for r in runs]
            out.append((i, url, host, source_key(source) if host and source else None, list(paths), [tuple(r) for r in runs]))
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "host": [o[2] for o in out], "page": pd.array([o[3] for o in out], dtype="Int64"), "paths": [o[4] for o in out], "runs": [o[5] for o in out]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, one row per row of pages. Null and empty sources give an empty text; pages without a host are judged by their own
    elements alone; repeated rows and null ids stay. Other columns are not looked at."""
    each, counts = distinct_pages(pages)
    told = told_pages(each, valid_classes(each), counts)
    rows = pages.select("page_id", "url", "html").mapInPandas(texts_of, TEXTS)
    copies = hot(counts, ["host", "page"], "hot-pages")
    rows, told = salted(rows, copies, ["host", "page"], F.xxhash64("page_id", "url")), salted(told, copies, ["host", "page"], None)
    joined = rows.join(told, ["host", "page", "salt"], "left").select("page_id", "url", "paths", "runs", "links", "fixed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for paths, runs, links, fixed in zip(b["paths"], b["runs"], b["links"], b["fixed"]):
                page = Page([Run(r["text"], paths[r["path"]], False, False, bool(r["marks"] & 1), bool(r["marks"] & 2), r["block"]) for r in runs])
                texts.append(main_text(page, frozenset(map(slot_key, links)) if links is not None else frozenset(), frozenset(fixed) if fixed is not None else frozenset()))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    return joined.mapInPandas(run, "page_id long, url string, text string")
