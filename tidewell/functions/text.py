"""Text expressions, all built-in functions so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acknowledgements that carry no content.
SHORT_ACKS = ["lol", "lmao", "haha", "hehe", "ok", "okay", "k", "thanks", "thank you", "ty", "thx", "nice", "cool", "wow", "gg", "yep", "yes", "no", "nah", "same", "true", "agreed", "exactly", "right", "correct", "got it", "makes sense", "understood", "clear", "gm", "gn", "good morning", "good night", "good evening"]
# Words the ranking ignores.
BM25_STOP = "a an the is are was were be been to of in on at for and or but if that this these those it its with as by from about into than then so do does did can could would should will what which who whom how when where why you your i we they he she them his her our their there here not no yes".split()
# Path segments that say nothing about a page.
URL_NOISE = "status statuses blob tree raw tag tags pull issues releases topics posts products watch starred users u profile category article articles blog home index main default overview readme".split()
# Grade categories; the last is the fallback.
CATEGORIES = "experience insight question resource introduction validation discussion meta social noise".split()


def strip(c: Column) -> Column:
    """Outer white space off, Unicode white space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    """Line ends as \\n, outer white space off."""
    return strip(F.regexp_replace(c, r"\r\n?", "\n"))


def heuristic_reason(text: Column, is_media: Column) -> Column:
    """Why a message is dropped before grading, by the first rule that holds; null if it is kept."""
    t = strip(F.coalesce(text, F.lit("")))
    media = is_media & (strip(F.replace(t, F.lit("<Media omitted>"), F.lit(""))) == "")
    ack = (F.size(F.split(t, r"(?U)\s+")) <= 3) & ~t.contains("?") & ~F.lower(t).contains("http") & F.lower(t).isin(SHORT_ACKS)
    return F.when(t == "", "empty").when(media, "media_only_no_caption").when(~t.rlike(r"[\p{L}\p{N}]"), "no_alphanumeric").when(ack, "short_acknowledgment")


def name_norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"[\s_-]+", " ")


def topic_key(c: Column) -> Column:
    """Folds spellings of a topic: lower case, runs of other characters as one space, plural s off words of more than three letters."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)), " ")


def bm25_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: ~t.isin(BM25_STOP))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(F.coalesce(c, F.lit(""))) + 3) / 4)).cast("long")


def snippet(c: Column, size: int = 300) -> Column:
    return F.when(F.length(c) > size, F.concat(F.regexp_replace(F.substring(c, 1, size - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(c)


def links_in(c: Column) -> Column:
    """Distinct links of a text in order, trailing punctuation off."""
    found = F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}>*_]+$", "")))


def url_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z][\w+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def url_title(c: Column) -> Column:
    """Host and the last two path segments that mean something."""
    path = F.split(F.regexp_extract(c, r"^[a-zA-Z][\w+.-]*://[^/?#]+/?([^?#]*)", 1), "/")
    said = F.filter(path, lambda p: (p != "") & ~F.lower(p).isin(URL_NOISE) & ~p.rlike("^[0-9]+$"))
    return F.array_join(F.concat(F.array(url_host(c)), F.when(F.size(said) > 2, F.slice(said, -2, 2)).otherwise(said)), " / ")


def video_id(c: Column) -> Column:
    one = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.coalesce(one(r"youtu\.be/([A-Za-z0-9_-]{1,64})"), one(r"[?&]vi?=([A-Za-z0-9_-]{1,64})"), one(r"youtube\.com/(?:shorts|live|embed|v)/([A-Za-z0-9_-]{1,64})"))


def clipped(c: Column, size: int) -> Column:
    """Cut with a mark where it is longer."""
    return F.when(F.length(c) > size, F.concat(F.regexp_replace(F.substring(c, 1, size), r"(?U)\s+$", ""), F.lit(" [...]"))).otherwise(c)


def masked_digits(c: Column, keep: int = 2) -> Column:
    return F.regexp_replace(c, rf"\d(?=(?:\D*\d){{{keep}}})", "#")


def json_string(c: Column) -> Column:
    """A JSON string literal that leaves characters beyond ASCII as they are."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, written in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(written))
    for code in [*range(0, 8), 11, *range(14, 32)]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


#: Namespace of URL names in version-5 identifiers (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Version-5 identifier of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def message_point_id(sent_at: Column, text: Column) -> Column:
    return uuid5(F.concat(F.lit("msg-"), sent_at, F.lit("-"), text))


def link_point_id(url: Column) -> Column:
    return uuid5(F.concat(F.lit("link-"), url))


def paste_id(url: Column) -> Column:
    return F.concat(F.lit("LNK-"), F.upper(F.substring(F.sha1(url), 1, 6)))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


# Words the older search ignores.
SEARCH_STOP = "a an the is are was were for and or of to in on at what how who which that this it with you do does did can could would should".split()
# How page addresses of a paywall, a login and a challenge show, and how a number looks like a phone's.
PAYWALL = r"(become a member|to continue reading|subscriber[- ]only|subscribe to read|sign in to read|unlock the (full|rest|article)|paid subscribers|premium article|this article is (behind|only for|available to)|membership required|read the full article with)"
LOGIN_PATH = r"(/login|/signin|/sign-in|/auth|/checkpoint|/captcha|/sessions)"
CHALLENGE = r"(just a moment|attention required|checking your browser|cf-chl)"
PHONE_LIKE = r"\+?\p{Nd}[\p{Nd}\s\x{A0}\x{202F}().-]{8,}\p{Nd}"
LINK_LIKE = r"https?://\S+|www\.\S+"
# How a text introduces its writer.
GREETING = r"^(?:hi|hello|hey|namaste|good (?:morning|evening)|greetings)(?:[^\p{L}\p{N}_]|$)"
FIRST_PERSON = r"(?:^|[^\p{L}\p{N}_])(?:i['’]?m|i am|my name|here)(?:[^\p{L}\p{N}_]|$)"

#: Window of a model, what it must keep free for its answer, and a margin.
CONTEXT_WINDOW, RESERVE, MARGIN = 32_768, 2048, 2000


def token_budget(prompt_tokens: Column, window: int = CONTEXT_WINDOW, reserve: int = RESERVE, margin: int = MARGIN) -> Column:
    """Tokens left for content beside a prompt, one at least."""
    return F.greatest(F.lit(1), F.lit(window - reserve - margin) - prompt_tokens).cast("long")


def search_terms(c: Column) -> Column:
    """Words of more than two characters that the older search looks for, in order, repeats kept."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: (F.length(t) > 2) & ~t.isin(SEARCH_STOP))


def phone_numbers(c: Column) -> Column:
    """What looks like a phone number once links are taken out."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), LINK_LIKE, " "), F.lit(f"({PHONE_LIKE})"), F.lit(1)), strip)


def introduces(c: Column) -> Column:
    """Whether the first 200 characters greet and speak in the first person, or say they introduce."""
    head = F.substring(F.lower(strip(F.coalesce(c, F.lit("")))), 1, 200)
    return head.rlike(GREETING) & head.rlike(FIRST_PERSON) | head.contains("introduce myself")


def repository(url: Column) -> Column:
    """(kind, owner, repo, ref, path) of an address of the code host; null for other hosts.

    raw.githubusercontent.com holds owner, repo, ref and path; elsewhere the third part says what
    follows. Whatever has another shape is `other`.
    """
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#:]+)", 1))
    seg = F.filter(F.split(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]+/?([^?#]*)", 1), "/"), lambda p: p != "")
    part = lambda i: F.coalesce(F.get(seg, F.lit(i)), F.lit(""))
    rest = lambda i: F.array_join(F.slice(seg, i + 1, F.greatest(F.lit(0), F.size(seg) - i)), "/")
    repo = F.regexp_replace(part(1), r"\.git$", "")
    of = lambda kind, *parts: F.struct(*[x.alias(n) for x, n in zip([kind if isinstance(kind, Column) else F.lit(kind), *parts, *[F.lit("")] * (4 - len(parts))], ("kind", "owner", "repo", "ref", "path"))])
    n, sub = F.size(seg), F.lower(part(2))
    known = (host.isin("github.com", "www.github.com", "gist.github.com") | host.endswith(".github.com") | host.contains("githubusercontent.com"))
    return F.when(
        known,
        F.when(host.contains("gist.github.com"), of("gist"))
        .when(host.contains("raw.githubusercontent.com"), F.when(n < 4, of("other")).otherwise(of("raw", part(0), repo, part(2), rest(3))))
        .when(n < 2, of("other"))
        .when(n == 2, of("repo", part(0), repo))
        .when(sub.isin("tree", "blob", "raw"), of(sub, part(0), repo, part(3), rest(4)))
        .when(sub.isin("issues", "discussions"), of(sub, part(0), repo))
        .when(sub.isin("pull", "pulls"), of("pulls", part(0), repo))
        .otherwise(of("other")),
    )


def embedded_text(kind: Column, text: Column, summary: Column, what: Column, problem: Column) -> Column:
    """What is embedded of an item: of a link its summary, what it is and what it solves, of a message its text."""
    said = F.concat_ws(" ", *[F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in (summary, what, problem)])
    return strip(F.when(kind == "link", said).otherwise(F.coalesce(text, F.lit(""))))


def has_content(*fields: Column) -> Column:
    return F.concat(*[strip(F.coalesce(c, F.lit(""))) for c in fields]) != ""


def holds_word(text: Column, word: Column) -> Column:
    """Whether the word stands in the text whole, in any case."""
    quoted = F.regexp_replace(F.lower(word), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?:^|[^\p{L}\p{N}_])"), quoted, F.lit(r"(?:[^\p{L}\p{N}_]|$)")))


def numbered(items: Column) -> Column:
    """A list as lines "1) …", for a prompt."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)), "\n")


def path_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")


def command(text: Column) -> Column:
    """What a bot message asks for, by its first letters; a link alone is to be ingested, any other text is a query."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(t.startswith("/start"), "start").when(t.startswith("/ask"), "query").when(t.startswith("/ingest") | t.startswith("/via"), "ingest").when(t.startswith("/paste"), "paste").when(t.startswith("/skip"), "skip").when(t.startswith("/blocked"), "blocked").when(t.contains("http://") | t.contains("https://"), "ingest").otherwise("query")


def command_parts(text: Column) -> Column:
    """(content, link_id, trusted) of a bot message, its command taken off.

    /ingest may carry --trusted; /via drops the name before a colon, or the first word; /paste has
    the id of a link before a colon, /skip nothing but the id.
    """
    t = strip(F.coalesce(text, F.lit("")))
    after = lambda c, word: strip(F.substring(c, F.lit(len(word) + 1), F.length(c)))
    colon = lambda c: F.instr(c, ":")
    ingest = F.when(t.startswith("/ingest"), after(t, "/ingest")).otherwise(t)
    trusted = ingest.startswith("--trusted") & ~t.startswith("/via")
    via, paste = after(t, "/via"), after(t, "/paste")
    no_name = F.when(colon(via) > 0, strip(F.substring(via, colon(via) + 1, F.length(via)))).when(via.rlike(r"[ \t]"), strip(F.regexp_replace(via, r"^[^ \t]*[ \t]", ""))).otherwise(via)
    kind = command(text)
    content = F.when(t.startswith("/ask"), after(t, "/ask")).when(t.startswith("/via"), no_name).when(kind == "ingest", F.when(trusted, after(ingest, "--trusted")).otherwise(ingest)).when(kind == "paste", F.when(colon(paste) > 0, strip(F.substring(paste, colon(paste) + 1, F.length(paste)))).otherwise(paste)).when(kind == "skip", "").otherwise(t)
    link = F.when(kind == "paste", F.when(colon(paste) > 0, strip(F.substring(paste, F.lit(1), colon(paste) - 1))).otherwise("")).when(kind == "skip", after(t, "/skip")).otherwise("")
    return F.struct(content.alias("content"), link.alias("link_id"), ((kind == "ingest") & trusted).alias("trusted"))


def json_objects(reply: Column, schema: str) -> Column:
    """The objects of a model's reply: fences off; one object, a list, or a list of lists; anything else gives none."""
    bare = strip(F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    one, many = F.from_json(bare, schema), F.from_json(bare, f"array<{schema}>")
    nested = F.flatten(F.from_json(bare, f"array<array<{schema}>>"))
    found = F.when(bare.startswith("{"), F.array(one)).when(bare.rlike(r"^\[\s*\["), nested).when(bare.startswith("["), many)
    return F.filter(F.coalesce(found, F.array().cast(f"array<{schema}>")), lambda x: x.isNotNull())
