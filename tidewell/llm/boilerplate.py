"""Page boilerplate: delete what neighbouring pages of a host share, keep the body.

Pages are range-partitioned by host and URL path, so neighbours in a partition are the nearest
URLs and a host of any size spreads over many partitions. Each page is aligned line by line with
the pages just before and after it by longest common subsequence; the share of neighbours in which
a line aligns is the main evidence. Lines that vary between pages (datelines, teasers, trails) are
told by their written form.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbours on each side, and the share of them from which an aligned line counts as shared.
NEIGHBOURS, SHARED = 10, 0.5

# Phrases of page furniture in English, German, French and Spanish.
_FURNITURE = re.compile(
    r"©|\(c\) ?\d{4}|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos|trademarks? belong|marques? appart|do not sell|"
    r"privacy policy|your privacy|privatsphäre|datenschutz|impressum|imprint|mentions légales|confidentialité|aviso legal|privacidad|terms of (?:use|service)|"
    r"^(?:we|wir|nous|nosotros|(?:this|our) (?:web)?(?:site|service|page)|ce (?:site|service)|este (?:sitio|servicio)|diese (?:seite|website)|unsere (?:seite|website)|notre (?:site|service)|nuestro sitio|avec nos|[\w-]+\.\w+)\b.{0,45}\b(?:cookies?|trackers?|traceurs?|rastreadores|vendors?|partners?|partenaires|socios|kleine dateien|petits fichiers|archivos pequeños|small files|local data|ähnliche technik)\b|"
    r"cookies? you allow|consent (?:can|may)|opt out|widerruf|store and access information|strictly necessary|analytics ones|auswahl jederzeit|vos choix à tout moment|tus preferencias|"
    r"^(?:accept|reject|allow|decline|manage|got it|agree)\b.{0,45}$|^(?:alle akzeptieren|ablehnen|einstellungen|verwalten|verstanden)\b|^(?:tout (?:accepter|refuser)|accepter|refuser|paramétrer)\b|^(?:aceptar|rechazar|configurar)\b|"
    r"subscribe|newsletter|sign up\b|weekly digest|in your inbox|become a member|^upgrade\b|free articles?|free guide|at no cost|ad[- ]free|hide (?:ads|banners)|join \d[\d.,]* readers|join the (?:forum|community|club)|early access|support independent|every issue of|^(?:register|create an account|install the app|get the app|download the app|try it free)\b|"
    r"abonnier|mitglied werden|probezeit|werbefrei|kostenlose? artikel|freie artikel|unabhängigen? journalismus|^(?:registrieren|konto anlegen|app (?:laden|installieren))|frühen zugang|abonnez|devenez membre|essai gratuit|articles? (?:gratuits?|offerts?)|jours offerts|sans publicité|^(?:inscrivez-vous|créez un compte|installez l.application|téléchargez)\b|accès anticipé|"
    r"suscr[ií]b|suscripción|hazte (?:socio|miembro)|artículos? gratis|días gratis|sin anuncios|prueba gratuita|^(?:regístrate|crea una cuenta|instala la aplicación|descarga)\b|acceso anticipado|"
    r"^(?:advertisement|sponsored\b.*|anzeige|werbung|publicité|publicidad|patrocinado\b.*|contenu sponsorisé.*|gesponsert\b.*)$|"
    r"share (?:this|on)\b|follow us|copy link|(?:artikel|beitrag|seite) teilen|teilen auf|partager (?:cet|sur)|suivez-nous|folgen sie uns|compartir (?:este|en)|síguenos|"
    r"(?:sign|log) in to (?:continue|comment|read)|log in to|melden sie sich an, um|anmelden, um|connectez-vous pour|inicia sesión para|"
    r"was this (?:page|article|post) helpful|war dieser (?:beitrag|artikel) hilfreich|cet article vous a|te (?:resultó|ha sido) útil|loading comments|kommentare werden geladen|"
    r"report a problem|fehler auf dieser seite|signaler (?:une|un) (?:erreur|problème)|informar de un|back to top|nach oben|haut de page|volver arriba|skip to content|zum inhalt springen|aller au contenu|ir al contenido|"
    r"chosen for you|recommended for you|because you read|weil sie|für sie ausgewählt|choisi pour vous|elegido para ti|made with care|"
    r"about the author|über den autor|über die autorin|à propos de l.auteur|sobre (?:el|la) autor|is a small magazine|kleines magazin|petit magazine|pequeña revista|run by volunteers|paid for by its readers|"
    r"^(?:tags?|topics?|filed under|posted in|schlagworte?|abgelegt unter|étiquettes?|mots-clés|classé dans|etiquetas|publicado en|archivado en)\b ?:?.*(?:,|\||:).*$",
    re.I,
)
_CONTENTS = re.compile(r"^(?:#+ )?(?:on this page|in this article|(?:table of )?contents|inhalt|inhaltsverzeichnis|auf dieser seite|in diesem artikel|sommaire|dans cet article|sur cette page|contenido|índice|en este artículo|en esta página)\s*:?$", re.I)
_DATED = re.compile(
    r"^(?:(?:last )?(?:updated|published|posted|modified|edited)\b.*\d{4}.*|(?:by|von|par|por) [^.!?]{2,40}[,·|] .*\d{4}|stand: ?\d.*|(?:zuletzt )?(?:aktualisiert|veröffentlicht)\b.*\d.*|(?:mis à jour|publié)\b.*\d.*|(?:actualizado|publicado)\b.*\d.*|"
    r".{0,40}\b\d+ min(?:uten?|utes?|utos)?\.?(?: (?:read|de lecture|de lectura))?\b.{0,3}[·|].*|.*[·|] ?\d+ min\b.*|listen to this (?:story|article)\b.*|lesezeit\b.*|\d+ min(?:utes?)? read\b.*|\d+ (?:comments?|kommentare|commentaires|comentarios|views|reactions|shares)|(?:page|seite|página) \d+ (?:of|von|sur|de) \d+|"
    r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\.? [^\W\d]{3,10}\.? \d{4})$",
    re.I,
)
_TEASERS = re.compile(r"^(?:#+ )?(?:more (?:from|on|about|in)\b.*|most (?:read|popular|viewed)|related(?: (?:posts?|articles?|stories|reading))?|you (?:may|might) also like|read (?:next|more|also)|keep reading|up next|recommended(?: .*)?|trending(?: .*)?|popular(?: .*)?|latest (?:posts|news|stories)|mehr (?:zum thema|von|aus)\b.*|meistgelesen|das könnte .*|auch interessant|ähnliche (?:artikel|beiträge)|weitere (?:artikel|beiträge)|à lire (?:aussi|ensuite)|les plus lus|articles? (?:liés|similaires)|plus d.articles|también te puede interesar|lo más leído|(?:artículos?|entradas) relacionad[oa]s|más (?:de|sobre)\b.*|sigue leyendo)\s*:?$", re.I)
_ITEM = re.compile(r"^(?:[•→›»▸◦‣] ?)?(?:\d+\. )?[^.!?|]{2,70}?(?: \(\d+\)| v?\d+\.\d+(?:\.\d+)*|(?: ?[:–—-] )[\w .'-]{2,40})$")
_BULLETED = re.compile(r"^[•→›»▸‣←] ?\S")
_ENTRY = re.compile(r"^(?:[-*•] |\d+(?:\.\d+)*[.)]? )")
_EXCERPT = re.compile(r"(?:\[\+\]|\.\.\.? ?»|… ?»|\(more\)|(?<=\w) »|>>|(?:\.\.\.|…) ?show more|read more|weiterlesen|mehr lesen|lire la suite|leer más|seguir leyendo|continue reading|(?:\.\.\.|…) ?(?:more|mehr|plus|más))\s*[»→›]?$", re.I)
_ARROWED = re.compile(r"(?: [→↑»]|^[←↑] ?.+)$")
_MENU_LINK = re.compile(r"\[[^\]]{1,40}\]\([^)]{1,80}\)")
_CODE = re.compile(r"^(?:pip3?|npm|yarn|cargo|go|apt(?:-get)?|brew|docker|git|curl|wget|make|python3?|sudo|cd|ls|export|import|from|def|class|return|if|for|while|const|let|var|\$|>>>|#!|//|/\*|[a-z_]\w* ?=|[a-z_][\w.]*\().*|^[}\])]+;?$")
_SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’»)\]]*(?: ?[\U0001F300-\U0001FAFF☺-➿]+)?$")
_DIGITS = re.compile(r"\d+")
_SEPARATED = re.compile(r" [|·•/] ")
_TRAIL = re.compile(r"^[^.!?>]{1,40}(?: [>›»/→] [^.!?>]{1,50})+$")

# Entries of site menus in English, German, French and Spanish.
_MENU = frozenset("home|about|about us|contact|contact us|pricing|products|blog|docs|careers|jobs|events|search|sign in|log in|login|menu|support|community|newsletter|changelog|topics|help|faq|startseite|über uns|kontakt|preise|produkte|karriere|suche|anmelden|menü|themen|hilfe|accueil|à propos|tarifs|produits|carrières|recherche|connexion|rubriques|aide|inicio|sobre nosotros|contacto|precios|productos|empleo|buscar|iniciar sesión|temas|ayuda".split("|"))

BODY, OTHER, UNSURE = 0, 1, 2


def masked(line: str) -> str:
    """What two pages compare: outer white space off, runs of digits as one."""
    return _DIGITS.sub("0", line.strip())


@lru_cache(200_000)
def written_form(text: str) -> int:
    """What the form of one line says: BODY, OTHER (furniture whatever the neighbours say) or UNSURE.

    The name of the page's own host is written HOST.
    """
    if text.startswith("#") and " " in text[:8]:
        return OTHER if _TEASERS.match(text) or _CONTENTS.match(text) else BODY
    if len(text) >= 160 and "©" not in text:
        # A long text that merely mentions such a word is an ordinary paragraph.
        return UNSURE
    if text.startswith("|") and text.endswith("|"):
        return BODY
    if _TEASERS.match(text) or _CONTENTS.match(text) or _DATED.match(text) or text.lstrip("-*• ").casefold() in _MENU:
        return OTHER
    if "HOST" in text and "://" not in text and "@" not in text:
        return OTHER
    if _FURNITURE.search(text):
        return OTHER
    if len(_MENU_LINK.findall(text)) >= 2 and len(_MENU_LINK.sub("", text).strip(" |·•-*")) < 10:
        return OTHER
    ended = bool(_SENTENCE_END.search(text))
    parts = _SEPARATED.split(text)
    if len(parts) >= 2 and not ended and all(0 < len(p) <= 34 and len(p.split()) <= 5 for p in parts):
        return OTHER
    if len(text) < 90 and _TRAIL.match(text):
        return OTHER
    if not ended and _CODE.match(text):
        return BODY
    if not ended and _BULLETED.match(text):
        return OTHER
    if not ended and not text.startswith(("- ", "* ")) and (_ITEM.match(text) or _ARROWED.search(text)):
        return OTHER
    return UNSURE


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence: equal beginnings and ends, and between them bit-parallel rows and a walk back."""
    top = 0
    while top < min(len(a), len(b)) and a[top] == b[top]:
        top += 1
    low = 0
    while low < min(len(a), len(b)) - top and a[-1 - low] == b[-1 - low]:
        low += 1
    last = [(len(a) - i, len(b) - i) for i in range(1, low + 1)]
    a, b = a[top : len(a) - low], b[top : len(b) - low]
    middle = [(i + top, j + top) for i, j in _between(a, b)] if a and b else []
    return last + middle + [(i, i) for i in reversed(range(top))]


def _between(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        m = where.get(x, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    pairs, j, i = [], len(b) - 1, len(a) - 1
    while i >= 0 and j >= 0:
        if not rows[i] >> j & 1 and (i == 0 or rows[i - 1] >> j & 1):
            if a[i] == b[j]:
                pairs.append((i, j))
                i, j = i - 1, j - 1
                continue
        if i > 0 and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            j -= 1
    return pairs


class _Page:
    __slots__ = ("link_id", "host", "title", "lines", "keys", "hits", "seen")

    def __init__(self, link_id: int, host: str, title: str, raw: str):
        self.link_id, self.host, self.title = link_id, host, title
        self.lines = [(n, x.strip()) for n, x in enumerate(raw.split("\n")) if x.strip()]
        self.keys = [masked(x) for _, x in self.lines]
        self.hits, self.seen = [0] * len(self.keys), 0

    def compare(self, other: _Page) -> None:
        for i, j in aligned(self.keys, other.keys):
            self.hits[i] += 1
            other.hits[j] += 1
        # A page that was cut short may end inside a line that its neighbours have whole.
        for short, long in ((self, other), (other, self)):
            if short.keys and len(short.keys[-1]) >= 3 and short.keys[-1] not in long.keys and any(k.startswith(short.keys[-1]) for k in long.keys):
                short.hits[-1] += 1
        self.seen += 1
        other.seen += 1

    def furniture(self) -> list[tuple[int, str]]:
        """Numbers of the lines that are not body, each with what tells it: aligned with the neighbours, or its form alone."""
        fences = [k for k, (_, x) in enumerate(self.lines) if x.startswith("```")]
        fenced = {k for a, b in zip(fences[::2], fences[1::2]) for k in range(a, b + 1)} if len(fences) % 2 == 0 else set(fences)
        names = {x.lstrip("# ").casefold() for _, x in self.lines}
        title, last = self.title.strip().casefold(), len(self.lines) - 1
        out, listing = [], False
        for k, (n, line) in enumerate(self.lines):
            if k in fenced or line.startswith("```"):
                listing = False
                continue
            text = line.replace(self.host, "HOST") if self.host else line
            excerpt = _EXCERPT.search(text)
            if excerpt and k == last:
                text, excerpt = text[: excerpt.start()].rstrip(" .…[("), None
            if title and line.casefold() == title and not listing:
                form = BODY
            elif excerpt:
                form = OTHER
            else:
                form = written_form(text)
            # Entries of a table of contents repeat headings of the page.
            if listing and form != OTHER:
                entry = _ENTRY.sub("", line).casefold()
                listing = (entry in names or line[:2] in ("- ", "* ") or line[:1].isdigit()) and not _SENTENCE_END.search(line)
                form = OTHER if listing else form
            listing = listing or bool(_CONTENTS.match(text))
            # Fewer neighbours say less: the bar rises as their number falls.
            shared = self.seen >= 3 and self.hits[k] / self.seen >= SHARED + 0.6 / self.seen
            if form == OTHER or form == UNSURE and shared:
                out.append((n, "aligned" if shared else "form"))
        return out


def _differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    window: deque[_Page] = deque()

    def told(pages: list[_Page]) -> pd.DataFrame:
        rows = [(p.link_id, *x) for p in pages for x in p.furniture()]
        return pd.DataFrame(rows, columns=["link_id", "line_no", "evidence"]).astype({"link_id": "int64", "line_no": "int32"})

    for batch in batches:
        ready: list[_Page] = []
        for link_id, host, title, raw in zip(batch["link_id"], batch["host"], batch["title"], batch["raw_text"]):
            page = _Page(link_id, host or "", title or "", raw)
            if window and window[-1].host != page.host:
                ready += window
                window.clear()
            for other in window:
                page.compare(other)
            window.append(page)
            if len(window) > NEIGHBOURS:
                ready.append(window.popleft())
        yield told(ready)
    yield told(list(window))


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """pages (link_id, url, title, raw_text) -> (link_id, line_no, evidence) of non-blank lines that are not body.

    Lines are separated by \\n and counted from 0. Null and empty texts and null ids give no rows;
    whole-row copies count once; a null url forms a host of its own; extra columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://[^/?#]+([^?#]*)", 1), "/+$", "")
    near = pages.where("link_id is not null and raw_text is not null and raw_text <> ''").select("link_id", host.alias("host"), path.alias("path"), "title", "raw_text")
    # Copies of a row have the same sort key, so they end up side by side in one partition; a repeated one is dropped by the final distinct.
    placed = near.repartitionByRange("host", "path", "link_id").sortWithinPartitions("host", "path", "link_id")
    unique = placed.groupBy("host", "path", "link_id").agg(F.first("title").alias("title"), F.first("raw_text").alias("raw_text")).sortWithinPartitions("host", "path", "link_id")
    return unique.mapInPandas(_differences, "link_id long, line_no int, evidence string")
