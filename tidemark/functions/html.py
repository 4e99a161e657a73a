"""Page extraction (P1-P5, T6, T7, W3): a linear markup reader of built-in expressions.

A page is cut into tokens by one pattern: text, comments and declarations, tags with their attributes, and elements whose content is
no markup (script, style, title ...) together with that content. Its loops are possessive, so the regex engine neither recurses nor
goes back: a tag of any length costs its length. One fold over the tags that matter then finds the spans of removed elements (P1), with
an element depth, so nested and unclosed elements end where a browser ends them. Title, description, body text and links are read
from the tokens outside these spans.

Rules followed: quotes count only where an attribute value starts; an unquoted value ends at a blank or ">"; the first of two equal
attributes counts; a tag, comment or raw element that is never closed takes the rest of the page; ``</x>`` closes the removed element x
that was opened last and everything in it; the end tag of an enclosing block ends the removed elements left open inside it; a form
inside a form is ignored; a button start ends an open button. Character references are decoded once per text: numeric ones by
code point, named ones by the HTML table, and the legacy names also without a semicolon (longest name first; inside an attribute only
if neither a letter, a digit nor "=" follows). Known limits: elements that a browser moves (content of tables, text after frames),
end tags that are implied for blocks other than BLOCKS, and CDATA inside svg.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import collapse_ws, snippet_cut, trim_ws

# Elements removed with their content before anything is read from a page.
REMOVED_TAGS = ["script", "style", "nav", "footer", "header", "iframe", "noscript", "svg", "button", "form"]
#: Of these, the ones that do not nest in themselves.
_FLAT_TAGS = ["form", "button"]
#: Elements whose end tag also ends what was left open inside them.
BLOCKS = ["div", "section", "article", "aside", "main", "ul", "ol", "dl", "table", "blockquote", "figure", "fieldset", "details", "center"]
_TRACKED = [*REMOVED_TAGS, *BLOCKS]
#: Elements whose content is not markup.
RAW_TEXT_TAGS = ["script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"]

_VALUE = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)"""
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+"
_ATTRIBUTES = rf"(?:[\s/]++|{_ATTRIBUTE})*+"
TOKEN_RE = "(?is)" + "|".join([
    r"[^<]++",
    r"<!--(?:-?>|.*?(?:--!?>|\z))",
    rf"<({'|'.join(RAW_TEXT_TAGS)})(?=[\s/>]){_ATTRIBUTES}(?:>|\z).*?(?=</\1[\s/>]|\z)",
    rf"</?[a-z][^\s/>]*+{_ATTRIBUTES}(?:>|\z)",
    r"<[!?/][^>]*+(?:>|\z)",
    "<",
])
NAME_RE = r"^<(/?[a-zA-Z][^\s/>]*+)"
RAW_CONTENT_RE = rf"(?is)^<[a-z]++{_ATTRIBUTES}>(.*)\z"
#: Raw elements whose content is text, with references and without.
REFERENCE_TEXT_TAGS = ["title", "textarea"]
UNDECODED_TAGS = ["noembed", "noframes", "xmp"]

#: A reference, a run without "&", or a "&" that starts no reference; in attributes a name takes a following "=" along.
REFERENCE_RE = r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[a-zA-Z][a-zA-Z0-9]*+%s?+)|[^&]++|&"
#: The commonest names first: a map is searched from its start.
_COMMON = ["amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot"]
#: Tag events that one inner fold handles; a page's spans are appended block by block, so that long pages cost no square of their length.
_FOLD_BLOCK = 512


def _bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable."""
    return F.get(F.transform(F.array(value), fn), 0)


def _map(pairs: dict[str, str]) -> Column:
    """A map of constants as one folded literal."""
    return F.map_from_arrays(F.split(F.lit("\n".join(pairs)), "\n"), F.split(F.lit("\x00".join(pairs.values())), "\x00"))


def named_references() -> dict[str, str]:
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return {k: names[k] for k in [*_COMMON, *sorted(names.keys() - set(_COMMON))]}


def legacy_references() -> dict[str, str]:
    """Names that count without a semicolon."""
    return {k: v for k, v in html5.items() if not k.endswith(";")}


def legacy_code_points() -> dict[str, str]:
    """Code points 128 to 159 stand for the characters that Windows-1252 has there."""
    out = {}
    for n in range(128, 160):
        try:
            out[str(n)] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return out


def _code_point(n: Column) -> Column:
    fine = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    code = F.when(fine, n).otherwise(F.lit(0xFFFD))
    own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(n.between(128, 159), F.coalesce(F.try_element_at(_map(legacy_code_points()), n.cast("string")), own)).otherwise(own)


def _number(reference: Column) -> Column:
    """The number of "&#..." (0 if it is beyond every code point)."""
    digits = F.regexp_extract(reference, "^&#[xX]?0*+([0-9a-fA-F]*+)", 1)
    value = F.when(F.rlike(reference, F.lit("^&#[xX]")), F.conv(F.left(digits, F.lit(7)), 16, 10)).otherwise(F.left(digits, F.lit(7)))
    return F.when(F.length(digits).between(1, 7), value.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _named(reference: Column, attribute: bool) -> Column:
    bare = F.rtrim(F.substr(reference, F.lit(2)), F.lit(";"))
    whole = F.when(F.endswith(reference, F.lit(";")), F.try_element_at(_map(named_references()), bare))
    legacy = legacy_references()
    if attribute:
        return F.coalesce(whole, F.try_element_at(_map(legacy), F.substr(reference, F.lit(2))), reference)
    lengths = sorted({len(k) for k in legacy}, reverse=True)
    parts = [F.try_element_at(_map({k: v for k, v in legacy.items() if len(k) == n}), F.substring(reference, 2, n)) for n in lengths]
    return F.coalesce(whole, *[F.concat(p, F.substr(reference, F.lit(n + 2))) for p, n in zip(parts, lengths, strict=True)], reference)


def decode_entities(text: Column, attribute: bool = False) -> Column:
    def one(piece: Column) -> Column:
        return (F.when(~F.startswith(piece, F.lit("&")) | (F.length(piece) < 3), piece)
                .when(F.startswith(piece, F.lit("&#")), _code_point(_number(piece)))
                .otherwise(_named(piece, attribute)))

    pieces = F.regexp_extract_all(text, F.lit(REFERENCE_RE % ("[;=]" if attribute else ";")), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def tokens(html: Column) -> Column:
    """(text, name) of each token; name is empty for text, comments and declarations and starts with "/" for end tags, in lower case."""
    name = lambda t: F.when(F.startswith(t, F.lit("<")) & (F.length(t) > 1), F.lower(F.regexp_extract(t, NAME_RE, 1))).otherwise(F.lit(""))
    return F.transform(F.regexp_extract_all(html, F.lit(TOKEN_RE), F.lit(0)), lambda t: F.struct(t.alias("text"), name(t).alias("name")))


def _tag_code(token: Column) -> Column:
    """Place in _TRACKED (from 1), negative for an end tag; 0 for anything else and for an svg that closes itself."""
    names, name = F.array(*[F.lit(t) for t in _TRACKED]), token["name"]
    return (F.when(F.length(name) == 0, F.lit(0).cast("long"))
            .when(F.startswith(name, F.lit("/")), -F.array_position(names, F.substr(name, F.lit(2))))
            .when((name == "svg") & F.endswith(token["text"], F.lit("/>")), F.lit(0).cast("long"))
            .otherwise(F.array_position(names, name))).cast("int")


def _bumped(counts: Column, k: Column, by: Column) -> Column:
    return F.transform(counts, lambda x, j: F.when(j == k - 1, F.greatest(x + by, F.lit(0))).otherwise(x))


def _zeros() -> Column:
    return F.array(*[F.lit(0)] * len(_TRACKED))


def _no_spans() -> Column:
    return F.array().cast("array<struct<first:int,last:int>>")


def _step(s: Column, e: Column) -> Column:
    """One tag. ``hidden`` is the outermost open removed element, ``outer`` counts the blocks open around it, ``inner`` what is open in it."""
    k, at, closes = F.abs(e["code"]), e["at"], e["code"] < 0
    block = k > len(REMOVED_TAGS)
    shown, same = s["hidden"] == 0, s["hidden"] == k
    flat = k.isin(*[REMOVED_TAGS.index(t) + 1 for t in _FLAT_TAGS])
    by = F.when(closes, -1).otherwise(1)
    around = ~shown & closes & ~same & block & (F.get(s["inner"], k - 1) == 0) & (F.get(s["outer"], k - 1) > 0)
    ends = around | (~shown & closes & same & (s["depth"] == 1))
    return F.struct(
        F.when(shown & ~closes & ~block, k).when(ends, F.lit(0)).otherwise(s["hidden"]).alias("hidden"),
        F.when(shown, F.lit(1)).when(same & ~(flat & ~closes), s["depth"] + by).otherwise(s["depth"]).alias("depth"),
        F.when(shown, at).otherwise(s["since"]).alias("since"),
        F.when(shown & block, _bumped(s["outer"], k, by)).when(around, _bumped(s["outer"], k, F.lit(-1))).otherwise(s["outer"]).alias("outer"),
        F.when(shown, _zeros()).when(~same, _bumped(s["inner"], k, by)).otherwise(s["inner"]).alias("inner"),
        F.when(ends, F.concat(s["spans"], F.array(F.struct(s["since"].alias("first"), at.alias("last"))))).otherwise(s["spans"]).alias("spans"))


def removed_spans(found: Column) -> Column:
    """First and last token (from 0) of each outermost removed element."""
    names = ["hidden", "depth", "since", "outer", "inner"]
    tags = F.filter(F.transform(found, lambda t, i: F.struct(i.alias("at"), _tag_code(t).alias("code"))), lambda e: e["code"] != 0)

    def fold(tags: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(tags) - 1) / _FOLD_BLOCK).cast("int")),
                             lambda b: F.slice(tags, b * _FOLD_BLOCK + 1, F.lit(_FOLD_BLOCK)))
        start = F.struct(F.lit(0).alias("hidden"), F.lit(1).alias("depth"), F.lit(0).alias("since"), _zeros().alias("outer"), _zeros().alias("inner"),
                         F.array().cast("array<array<struct<first:int,last:int>>>").alias("spans"))

        def one_block(s: Column, block: Column) -> Column:
            inside = F.aggregate(block, F.struct(*[s[n].alias(n) for n in names], _no_spans().alias("spans")), _step)
            return _bind(inside, lambda r: F.struct(*[r[n].alias(n) for n in names], F.concat(s["spans"], F.array(r["spans"])).alias("spans")))

        def whole(s: Column) -> Column:
            rest = F.array(F.struct(s["since"].alias("first"), (F.size(found) - 1).alias("last")))
            return F.concat(F.flatten(s["spans"]), F.when(s["hidden"] > 0, rest).otherwise(_no_spans()))

        return F.when(F.size(tags) > 0, F.aggregate(blocks, start, one_block, whole)).otherwise(_no_spans())

    return _bind(tags, fold)


def outside(found: Column, spans: Column) -> Column:
    """The tokens outside ``spans``, in order."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["last"] + 1))
    ends = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.size(found)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(found, a + 1, F.greatest(b - a, F.lit(0)))))
    return F.when(F.size(spans) == 0, found).otherwise(kept)


def token_text(token: Column) -> Column:
    """The text that a token holds: its own, or the content of a raw element; tags hold nothing, not a blank (K8)."""
    text, name = token["text"], token["name"]
    plain = ~F.startswith(text, F.lit("<")) | (F.length(text) == 1)
    held = (F.when(plain, text).when(name.isin(*REFERENCE_TEXT_TAGS, *UNDECODED_TAGS), F.regexp_extract(text, RAW_CONTENT_RE, 1)).otherwise(F.lit("")))
    return _bind(held, lambda h: F.when(name.isin(*UNDECODED_TAGS), h).otherwise(decode_entities(h)))


def strip_tags(fragment: Column) -> Column:
    """Text content of a fragment."""
    return F.array_join(F.transform(tokens(fragment), token_text), "")


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute ``name`` as it is written; empty where it has none."""
    pattern = rf"(?is)^<[a-z][^\s/>]*+(?:[\s/]++|(?!{name}[\s/>=]){_ATTRIBUTE})*+{name}\s*+=\s*+({_VALUE})"
    quoted = lambda v: F.startswith(v, F.lit('"')) | F.startswith(v, F.lit("'"))
    return _bind(F.regexp_extract(tag, pattern, 1), lambda v: F.when(quoted(v), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))


def _tags(found: Column, name: str) -> Column:
    """The complete start tags of one element."""
    kept = F.filter(found, lambda t: (t["name"] == name) & F.endswith(t["text"], F.lit(">")))
    return F.transform(kept, lambda t: t["text"])


def _first_heading(names: Column, texts: Column) -> Column:
    """Text between the first h1 and the next end tag of a heading."""
    heading_ends = [f"/h{n}" for n in range(1, 7)]

    def text(start: Column) -> Column:
        end = F.array_position(F.transform(F.slice(names, start + 1, F.size(names)), lambda n: n.isin(*heading_ends)), F.lit(True)).cast("int")
        return F.array_join(F.slice(texts, start + 1, F.when(end > 0, end).otherwise(F.size(texts))), "")

    return _bind(F.array_position(names, "h1").cast("int"), lambda at: F.when(at > 0, text(at)))


def _description(found: Column) -> Column:
    """Content of the first meta tag named description, or if it is empty of the first with the property og:description; null if both are."""
    def content(key: str, value: str) -> Column:
        metas = F.filter(_tags(found, "meta"), lambda m: raw_attribute(m, key) == value)
        return F.nullif(raw_attribute(F.get(metas, 0), "content"), F.lit(""))

    return decode_entities(F.coalesce(content("name", "description"), content("property", "og:description")), attribute=True)


def extract_links(found: Column, limit: int | None = None) -> Column:
    """P5 + W3: non-empty href values of <a> tags in document order, before de-duplication; the first ``limit`` if one is given."""
    kept = F.filter(F.transform(_tags(found, "a"), lambda t: decode_entities(raw_attribute(t, "href"), attribute=True)), lambda v: F.length(v) > 0)
    return kept if limit is None else F.slice(kept, 1, limit)


def add_page_fields(pages: DataFrame, url: str = "url", html: str = "html",
                    links_before_removal: bool = False, max_links: int | None = None) -> DataFrame:
    """Append title, snippet, body_text and links.

    title: first <title> text trimmed, else first <h1> text trimmed, else the url (P2).
    snippet: content of the first meta description, else of the first og:description, else the body text cut to 200 characters (P3, T7).
    body_text: all text outside removed elements and the title, references decoded, whitespace collapsed (P4, T6): a page always has a
    body, and text after its end tag belongs to it. links: see ``extract_links``; with ``links_before_removal`` they are read from all
    tokens (K7 option: links inside nav, header, footer are kept; scripts, styles and comments never hold tags). A null page gives a
    null body_text and no links.
    """
    keep = [F.col(c) for c in pages.columns]
    read = pages.select(*keep, tokens(F.col(html)).alias("_tokens"))
    kept = read.select(*keep, "_tokens", _bind(removed_spans(F.col("_tokens")), lambda s: outside(F.col("_tokens"), s)).alias("_kept"))
    names = F.transform("_kept", lambda t: t["name"])
    read = kept.select(*keep, "_tokens", "_kept", names.alias("_names"), F.transform("_kept", token_text).alias("_texts"))
    names, texts = F.col("_names"), F.col("_texts")
    title = F.get(texts, F.array_position(names, "title").cast("int") - 1)
    shown = F.zip_with(texts, names, lambda t, n: F.when(n == "title", F.lit("")).otherwise(t))
    fields = read.select(
        *keep,
        F.coalesce(F.nullif(trim_ws(title), F.lit("")), F.nullif(trim_ws(_first_heading(names, texts)), F.lit("")), F.col(url)).alias("title"),
        _description(F.col("_kept")).alias("_meta"),
        collapse_ws(F.array_join(shown, "")).alias("body_text"),
        extract_links(F.col("_tokens" if links_before_removal else "_kept"), max_links).alias("links"),
    )
    return fields.select(
        *keep, "title",
        F.coalesce(F.col("_meta"), snippet_cut(F.col("body_text"))).alias("snippet"),
        "body_text", "links",
    )
