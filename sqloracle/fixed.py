"""Fixed values of the oracle statements, written out here: the statements share nothing with the Spark code."""

from __future__ import annotations

import html.entities

# The stop list of the indexed language, alphabetical.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can did do does doing down during each few for from further had has have he her here his how i if in into is it its me "
    "more most my no nor not of off on once only or other our out over own same she should so some such than that the their "
    "them then there these they this those through to too under until up very was we were what when where which while who "
    "whom why with would you your"
).split()

# White space of the page text rules, as an RE2 class.
WHITESPACE_CLASS = (
    r"[\t\n\f\r \x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)

# Porter's measure conditions and suffix tables.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURE_GT0 = f"^({_C})?{_V}{_C}"
MEASURE_GT1 = f"^({_C})?({_V}{_C}){{2,}}"
MEASURE_EQ1 = f"^({_C})?{_V}{_C}({_V})?$"
HAS_VOWEL = f"^({_C})?[aeiouy]"
ENDS_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# Query keys that canonical urls drop, and the split of a url.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "igshid"]
ABS_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(.*)$"
SPECIAL_REST_RE = r"^[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
REL_RE = r"^([^?#]*)(\?[^#]*)?(#.*)?$"
HOST_FORBIDDEN_RE = r"[\s#%/:<>?@\[\\\]^|]"
PATH_ENCODE_RE = r'[^\x21-\x7e]|["<>`{}]'

# Removed elements, and the grammar of tags.
RAW_TEXT_TAGS = ["script", "style"]
REMOVED_TAGS = ["nav", "footer", "header", "iframe", "noscript", "svg", "button", "form"]
_ATTRIBUTES = r"""(?:[\s/](?:[^>"']|"[^"]*"|'[^']*')*)?"""


def open_tag(name: str) -> str:
    return f"<{name}{_ATTRIBUTES}>"


def element(name: str) -> str:
    return rf"(?is){open_tag(name)}.*?</{name}\s*>"


def until_close(name: str) -> str:
    return rf"(?is){open_tag(name)}(.*?)(?:</{name}\s*>|\z)"


COMMENT = r"(?s)<!--.*?(?:-->|\z)"
ANY_TAG = r"""</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>"""
DECLARATION = r"<[!?][^>]*>"
DESCRIPTION = r"""(?s)[\s"'/](?i:name)\s*=\s*(?:"description"|'description'|description[\s/>])"""
OG_DESCRIPTION = r"""(?s)[\s"'/](?i:property)\s*=\s*(?:"og:description"|'og:description'|og:description[\s/>])"""
CONTENT = r"""(?is)[\s"'/]content\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
_ATTRIBUTE = r"""[\s/]+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]*))?"""
HREF = rf"""(?is)<a(?:{_ATTRIBUTE})*?[\s/]+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)|[^&]+|&"
ATTRIBUTE_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*[;=]?)|[^&]+|&"
NAMED = {k.rstrip(";"): v for k, v in html.entities.html5.items() if k.endswith(";")}
WITHOUT_SEMICOLON = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
WINDOWS_1252 = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}

# The card's address and score, and the dictionary answers of the scenario.
CARD_URL = "https://dictionary.cambridge.org/dictionary/english/"
CARD_SCORE = 100.0
DICTIONARY = {
    "click": '[{"word":"click","phonetic":"/klɪk/","phonetics":[{"text":"/klɪk/"}],"meanings":[{"partOfSpeech":"verb",'
             '"definitions":[{"definition":"To press a mouse button."}]}]}]',
    "view": '[{"word":"view","phonetic":"","phonetics":[{"text":""},{"text":"/vjuː/"}],"meanings":[{"partOfSpeech":"noun",'
            '"definitions":[{"definition":"The act of seeing."}]}]}]',
    "purchase": '[{"word":"purchase","phonetics":[],"meanings":[{"partOfSpeech":"verb","definitions":[{"definition":"To buy."}]}]}]',
    "signup": '[{"word":"signup","meanings":[]}]',
}

# Clocks and texts of the scenarios.
FIRST_CRAWL_AT, SECOND_CRAWL_AT = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
REVISION = "<p>revised edition</p></article>"
QUEUE_AT, AS_OF = "2024-01-01 10:00:00", "2024-01-01 10:05:00"
AGENTS = ["TidemarkBot/1.0", "GleanerBot/2.0"]
ROBOTS_TEXTS = [
    "",
    "User-agent: *\nDisallow: /en/\nCrawl-delay: 2\n\nUser-agent: TidemarkBot\nDisallow: /fr/\nAllow: /fr/1\n",
    "# house rules\nUser-agent: *\nDisallow: /\nAllow: /de/*$\n\nUser-agent: OtherBot\nUser-agent: TidemarkBot\n"
    "Disallow: /es/\nAllow: /es/*5$\nCrawl-delay: 5\n",
]
ENTITY_FORMS = ('<a data-href="/lost" href="/found?x=1&amp;y=2" title="p > q">more</a><p title="a > b">caf&#233; &eacute;t&eacute; &#8217;&#x2014;&mdash; '
                '&amp;lt; &#146; &nosuch; &#0;</p><nav-bar>bar</nav-bar><!-- <a href="/hidden">h</a> -->')
# What the harder markup of ``page_markup`` shows, written in plain markup.
PLAIN_MARKUP = (
    '<p>|</p><div></div><p>after |</p><p>tail |kept |out |apostrophe |</p><a href="/' + "x" * 3000 + '">long</a> |shown '
    '|© 2020 &amp;x ¬it; ∉ é é x |<a href="?a=1&amp;copy=2&amp;lt=3&lt;">refs</a>|&lt;b&gt;typed&lt;/b&gt; |1 &lt; 2 |'
)
# Canonical host (none where a browser refuses the written form) and port of each written form in ``url_hosts``.
CANONICAL_HOSTS = [
    ("xn--mller-kva.de", ""), ("xn--mller-kva.de", ""), ("127.0.0.1", ""), ("127.0.0.1", ""), ("[::1]", ":80"), ("[2001:db8::1:0:0:1]", ""),
    ("[::ffff:c0a8:1]", ""), ("xn--bcher-kva.xn--r8jz45g.jp", ""), ("example.org", ""), ("127.0.0.1", ""), ("a..b.test", ""), (None, ""),
]
