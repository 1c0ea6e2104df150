"""Text functions: market taxonomies, named entities, correlation keys, formatting, press and docket texts.

All are Column expressions. Patterns and word lists are fixed values, shared with the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered rules of the market category. The first pattern that a lower-cased text has decides; "" is out of scope.
CATEGORY_RULES = (
    ("", r"\bsport|\bnfl\b|\bnba\b|\bwnba\b|\bmlb\b|\bnhl\b|\bufc\b|soccer|football|basketball|baseball|hockey|tennis|\bgolf\b|\bf1\b|grand prix|\bmatch\b|\bgame\b|\bleague\b|playoff|super ?bowl|world cup|lakers|celtics|yankees|warriors|\bchiefs\b|win game|moneyline|to score|goalscorer|\bpoints\b|\brebounds\b|\bmvp\b|exact score|scoreline|\bscore\b|fifa|uefa|\bolympic|premier league|la liga|champions league|shootout|knockout|quarter-?final|semi-?final|\bcricket\b|\brugby\b|nascar|formula ?1"),
    ("", r"price (of|target|above|below|reach|hit|prediction)|hit \$|reach \$|above \$|below \$|\$[0-9]|close (above|below)|all-time high|\bath\b|market ?cap|flippening|trade(s| at| above| below)"),
    ("", r"weather|temperature|hottest|coldest|hurricane|rainfall|snowfall|climate|\bel ni|degrees|\brain\b"),
    ("", r"\bmention|say the word|number of (posts|tweets|times)|how many (times|posts|tweets)|tweet count"),
    ("Military & Defense", r"military|defense|defence|airstrike|air ?base|troop|missile|\bwar\b|warfare|nato|sanction|basing|carrier|drone|nuclear|ceasefire|hostage|strait|hormuz|blockade|invade|invasion|incursion|occupy|occupation|\bseize|\bcapture[d]?|operation|special forces|coup|overthrow|regime|supreme leader|ayatollah|khamenei|airspace|strike on"),
    ("Elections", r"election|midterm|primary|ballot|electoral|turnout|runoff"),
    ("Economics", r"econom|inflation|\bcpi\b|\bpce\b|\bfed\b|fomc|\bgdp\b|jobs report|payroll|unemploy|jobless|rate (cut|hike|decision)|interest rate|recession"),
    ("Legal & Regulatory", r"\bindict|\bcharged?\b|\barrest|convict|acquit|verdict|\bguilty\b|sentenc|\bplea\b|lawsuit|\bsued?\b|settle(ment|s)?|subpoena|grand jury|\bsec\b|\bfda\b|\bftc\b|\bdoj\b|antitrust|regulat|\bapprov|\bban(ned|s)?\b|\bfine[ds]?\b|investigat|\bruling\b|\bcourt\b|\btrial\b|extradit|pardon|tariff|sanction"),
    ("Corporate & M&A", r"acquir|acquisition|\bmerger\b|merge with|buyout|takeover|\bipo\b|go public|bankrupt|chapter 11|layoff|\bceo\b|\bcfo\b|step down as|fired as|resign as|\bearnings\b|delist|spin ?off|stock split|dividend|guidance|\bfunding round|valuation"),
    ("Politics", r"politic|president|prime minister|\bpm\b|chancellor|senate|congress|governor|cabinet|nominee|confirm|impeach|resign|pardon|executive order|supreme court|\bout (by|in|before)\b|step down|leave office|leaves office|removed from|remain in office|stay in power|stays in power|ousted|ouster|\boust\b|in power|survive|toppl|in office"),
    ("Tech & Announcements", r"\bannounc|unveil|\blaunch|\breleas(e|ed|ing)|\breveal|\bgpt-?[0-9]|gemini ?[0-9]|\bai model|new model|\bllm\b|\bbrowser\b|chatbot|partnership|integration|\bships?\b in|year in search|most[- ]searched|#? ?1 (most )?(searched|trending)|trending (person|searches?)|search ranking"),
    ("Crypto Events", r"list(ing|ed|s)?\b|\bdelist|\bhack|exploit|drained|\betf\b|spot etf|rug ?pull|depeg|insolven|halt withdrawals|mainnet|hard fork|governance vote|\bairdrop|token unlock|coinbase|binance|kraken|\bgemini\b"),
    ("World", r"\bnobel\b|laureate|peace prize|\bpulitzer\b"),
    ("Culture", r"culture|entertain|\bmovie|\bfilm\b|box office|oscar|grammy|emmy|golden globe|\baward|\balbum\b|streaming chart|number one|\bnetflix\b|renew(ed|al)|engaged|engagement|getting married|\bmarriage\b|\bdivorce|\bpregnan|expecting a baby|breakup|\bbreak up\b"),
    ("World", r"geopolit|treaty|summit|peace deal|coup|foreign|diplomat|annex|\bborder\b|maduro|venezuela|caracas|\biran\b|tehran|israel|gaza|hezbollah|hamas|ukraine|russia|kremlin|putin|taiwan|north korea|\bdprk\b|kim jong|syria|lebanon|yemen"),
)
# Labels for what no category rule has.
FALLBACK_RULES = (
    ("Sports", r"\bsport|nfl|nba|wnba|mlb|nhl|\bufc\b|soccer|football|basketball|baseball|hockey|tennis|golf|\bf1\b|grand prix|\bmatch\b|\bgame\b|league|playoff|lakers|celtics|yankees|warriors|chiefs"),
    ("Crypto", r"crypto|bitcoin|\bbtc\b|ethereum|\beth\b|solana|\bsol\b|token|coin|price of|hit \$"),
)
# The surveillance taxonomy, five excluded kinds and nine detectable ones.
EXCLUDED = ("Sports", "Crypto", "Commodities", "Climate", "Mentions")
TAXONOMY_RULES = (
    ("Sports", r"\bsport|nfl|nba|wnba|mlb|nhl|\bufc\b|soccer|football|basketball|baseball|hockey|tennis|golf|\bf1\b|grand prix|\bmatch\b|\bgame\b|league|playoff|champions|\bcup\b|olympic|medal|goalscorer|moneyline|over/under|to score"),
    ("Crypto", r"crypto|bitcoin|\bbtc\b|ethereum|\beth\b|solana|\bsol\b|\bxrp\b|dogecoin|\bdefi\b|memecoin|\$?\bnft\b|token price|coin price"),
    ("Commodities", r"commodit|crude|\boil\b|\bwti\b|\bbrent\b|\bgold\b|silver|natural gas|\bgasoline\b|wheat|corn|copper"),
    ("Climate", r"climate|weather|temperature|hottest|hurricane|rainfall|snowfall|\bel ni|drought"),
    ("Mentions", r"\bmention|say the word|include the word|keyword"),
    ("Elections", r"election|midterm|primary|\bballot|electoral|turnout|swing state|popular vote"),
    ("Economy", r"econom|inflation|\bcpi\b|\bpce\b|\bfed\b|fomc|\bgdp\b|jobs report|payroll|unemploy|jobless|rate (cut|hike|decision)|interest rate|recession"),
    ("Finance", r"financ|s&p|\bspx\b|nasdaq|\bdow\b|treasury|\byield\b|\bvix\b|stock market|equit|\bbond\b|credit"),
    ("Business", r"business|\bcompan|corporate|earnings|merger|acquisition|\bipo\b|\bceo\b|bankruptc|layoff|antitrust|guidance"),
    ("Tech & Science", r"\btech\b|technolog|\bai\b|artificial intelligence|\bllm\b|\bgpt\b|science|\bnasa\b|space|rocket|satellite|fusion|semiconductor|\bchip\b|frontier (lab|model)"),
    ("Health", r"health|\bfda\b|vaccine|pandemic|outbreak|disease|\bdrug\b|clinical|medic|\bcdc\b|\bwho\b"),
    ("Culture", r"culture|entertain|\bmovie|\bfilm\b|box office|oscar|academy award|grammy|emmy|\balbum\b|\bmusic\b|\btv\b|series|celebrit|streaming chart"),
    ("World", r"world|geopolit|\bwar\b|ukraine|russia|israel|gaza|\biran\b|china|taiwan|north korea|\bnato\b|ceasefire|sanction|\bcoup\b|nuclear|missile|airstrike|hostage|treaty|summit|foreign|border"),
    ("Politics", r"politic|president|congress|senate|\bhouse\b|governor|cabinet|supreme court|shutdown|impeach|nominee|confirm|government|parliament|prime minister|chancellor|resign|appoint"),
)
# Words that name no entity, and words that join the parts of a name.
ENTITY_STOP = (
    "will the a an be by before after above below between than over under of and or to in on at as is are was were yes no not more less least reach hit "
    "reported this that these those market markets price prices odds trade trades average moving total count calls value level rate number day days week "
    "month year win wins won lose end january february march april may june july august september october november december monday tuesday wednesday "
    "thursday friday saturday sunday q1 q2 q3 q4"
).split()
CONNECTORS = ("of", "the", "and", "for", "de", "du", "von", "&", "-")
# Classes of action in a correlation key, in order.
ACTIONS = (
    ("mil", r"strik|attack|militar|\bwar\b|engage|bomb|invad|missile|nuclear|troop|forces|\bhit\b"),
    ("reg", r"\bout\b|leave|leav|\bfall\b|falls|resign|oust|removed|remove|step ?down|\bexit\b|impeach|overthrow"),
    ("peace", r"ceasefire|cease-fire|\bpeace\b|truce|\bdeal\b|agreement"),
    ("elec", r"\bwin\b|\bwins\b|elect|nominee|preside|primary"),
)
# What puts a press item in scope, and what makes it an enforcement action.
SCOPE = ("prediction market", "event contract", "kalshi", "polymarket", "180.1", "insider", "misappropriat", "eddie murphy", "van dyke", "spagnuolo", "year in search", "maduro")
ENFORCEMENT = ("charg", "indict", "complaint", "order instituting", "settl", "fined", "penalt", "insider", "misappropriat", "fraud", "manipulat", "disgorge")
OFFICIAL = r"reuters|associated press|\bap\b|bloomberg|official|\.gov|federal|white house|department"
SOCIAL = r"twitter|x\.com|reddit|telegram|truth social"
#: Words of a caption that keep their own case.
KEEP_CASE = {"llc": "LLC", "inc": "Inc.", "lp": "LP", "llp": "LLP", "cftc": "CFTC", "sec": "SEC", "ngcb": "NGCB", "usa": "USA", "us": "US", "kalshiex": "KalshiEX", "kalshiex,": "KalshiEX,", "ii": "II", "iii": "III", "na": "N.A.", "dba": "d/b/a"}


def first_rule(text: Column, rules, otherwise: Column) -> Column:
    """The name of the first rule whose pattern the text has."""
    said = None
    for name, pattern in rules:
        said = (F if said is None else said).when(text.rlike(pattern), F.lit(name))
    return said.otherwise(otherwise)


def category(tags: Column, question: Column) -> Column:
    """Market category of the tags and the question; null if they are out of scope or nothing fits."""
    text = F.lower(F.concat(F.array_join(tags, " "), F.lit(" "), F.coalesce(question, F.lit(""))))
    return F.nullif(first_rule(text, CATEGORY_RULES, F.lit("")), F.lit(""))


def category_fallback(title: Column) -> Column:
    return first_rule(F.lower(F.coalesce(title, F.lit(""))), FALLBACK_RULES, F.lit("Other"))


def taxonomy(raw: Column) -> Column:
    """Canonical kind of a tag or question; null if nothing fits. Kinds in ``EXCLUDED`` can't be scored."""
    return first_rule(F.lower(F.coalesce(raw, F.lit(""))), TAXONOMY_RULES, F.lit(None).cast("string"))


def classify_market(tags: Column, question: Column) -> Column:
    """The first detectable kind among the tags; else null if a tag is excluded; else that of the question, if detectable."""
    kinds = F.filter(F.transform(tags, taxonomy), lambda k: k.isNotNull())
    detectable = F.get(F.filter(kinds, lambda k: ~k.isin(*EXCLUDED)), F.lit(0))
    asked = taxonomy(question)
    return F.when(detectable.isNotNull(), detectable).when(F.size(kinds) > 0, F.lit(None)).when(~asked.isin(*EXCLUDED), asked)


def entities(question: Column) -> Column:
    """Up to four named entities: runs of capitalised words with their connectors, and acronyms; most words first, then longest.

    A connector belongs to a run between two capitalised words. Generic words are cut from both ends of a run; a run of
    generic words, and a single short word that is no acronym, is none.
    """
    words = F.filter(F.split(F.regexp_replace(question, "[?,;:()\"“”‘’'.]", " "), r"\s+"), lambda w: w != "")
    stop = F.array(*map(F.lit, sorted({*ENTITY_STOP, *CONNECTORS})))
    joins = F.array(*map(F.lit, CONNECTORS))

    def capital(w: Column) -> Column:
        return w.rlike("^[A-Z][A-Za-z0-9&/-]*$")

    def acronym(w: Column) -> Column:
        return w.rlike("^[A-Z]{2,6}$")

    def generic(w: Column) -> Column:
        return F.array_contains(stop, F.lower(w))

    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def found(ws: Column) -> Column:
        def inside(w: Column, i: Column) -> Column:
            near = F.coalesce(capital(F.get(ws, i - 1)) & capital(F.get(ws, i + 1)), F.lit(False))
            return F.when(capital(w), w).when(F.array_contains(joins, F.lower(w)) & near, F.lower(w)).otherwise(F.lit("\x01"))

        runs = F.transform(F.split(F.array_join(F.transform(ws, inside), " "), "\x01"), lambda r: F.filter(F.split(r, " "), lambda w: w != ""))

        def trimmed(run: Column) -> Column:
            kept = F.transform(run, lambda w: ~generic(w))
            first = F.array_position(kept, F.lit(True)).cast("int")
            last = (F.size(run) + 1 - F.array_position(F.reverse(kept), F.lit(True))).cast("int")
            return F.when(first > 0, F.slice(run, first, last - first + 1)).otherwise(F.slice(run, 1, 0))

        def names(run: Column) -> Column:
            own = F.filter(run, lambda w: ~generic(w))
            return (F.size(own) > 1) | ((F.size(own) == 1) & (acronym(F.get(own, F.lit(0))) | (F.length(F.get(own, F.lit(0))) > 3)))

        named = F.transform(F.filter(F.transform(runs, trimmed), names), lambda r: F.array_join(r, " "))
        alone = F.filter(ws, lambda w: acronym(w) & ~F.array_contains(F.array(*map(F.lit, ENTITY_STOP)), F.lower(w)))
        every = F.filter(F.array_distinct(F.concat(named, alone)), lambda e: F.length(e) >= 2)
        order = F.array_sort(F.transform(every, lambda e, i: F.struct((-F.size(F.split(e, " "))).alias("n"), (-F.length(e)).alias("l"), i.alias("i"), e.alias("e"))))
        return F.transform(F.slice(order, 1, 4), lambda x: x["e"])

    return F.when(question.isNull(), F.array().cast("array<string>")).otherwise(bound(words, found))


def correlation_key(question: Column) -> Column:
    """The event that a question is about: its two leading entities, sorted, and the class of action; null without an entity."""
    top = F.transform(F.slice(entities(question), 1, 2), lambda e: F.regexp_replace(F.lower(e), "[^a-z0-9]+", ""))
    top = F.array_sort(F.filter(top, lambda e: e != ""))
    action = first_rule(F.lower(question), ACTIONS, F.lit("x"))
    return F.when(F.size(top) > 0, F.concat(F.array_join(top, "-"), F.lit("|"), action))


def _scaled(x: Column, unit: float, letter: str) -> Column:
    return F.concat(F.regexp_replace(F.format_string("%.1f", x / unit), "\\.0$", ""), F.lit(letter))


def money(value: Column) -> Column:
    """``$1.2M``, ``$34K``, ``$56``; negative amounts keep their sign after the dollar."""
    v = F.floor(value + 0.5)
    text = F.when(F.abs(v) >= 1e6, _scaled(v, 1e6, "M")).when(F.abs(v) >= 1e3, F.concat(F.floor(v / 1e3 + 0.5).cast("string"), F.lit("K"))).otherwise(v.cast("string"))
    return F.concat(F.lit("$"), text)


def signed_money(value: Column) -> Column:
    return F.concat(F.when(value + 0.5 >= 0, F.lit("+")).otherwise(F.lit("−")), money(F.abs(F.floor(value + 0.5))))


def date_text(ts: Column) -> Column:
    """``Mar 04 2025`` of epoch seconds."""
    return F.date_format(F.timestamp_seconds(ts), "MMM dd yyyy")


def short_address(address: Column) -> Column:
    return F.when(F.length(address) > 10, F.concat(F.substring(address, 1, 4), F.lit("…"), F.substring(address, -4, 4))).otherwise(F.coalesce(address, F.lit("")))


def one_in(p: Column) -> Column:
    """``1 in 1.5M`` of a probability."""
    n = F.when(p > 0, F.floor(1 / p + 0.5))
    text = F.when(n.isNull() | (n >= 1e12), F.lit(">1T")).when(n >= 1e9, _scaled(n, 1e9, "B")).when(n >= 1e6, _scaled(n, 1e6, "M")).when(n >= 1e3, _scaled(n, 1e3, "K")).otherwise(F.greatest(F.lit(1), n).cast("string"))
    return F.concat(F.lit("1 in "), text)


def p_text(p: Column) -> Column:
    said = F.when(p <= 0, F.lit("p < 1e-7"))
    for bound, text in ((1e-6, "1e-6"), (1e-4, "1e-4"), (1e-3, "0.001"), (0.01, "0.01"), (0.05, "0.05")):
        said = said.when(p < bound, F.lit(f"p < {text}"))
    return said.otherwise(F.concat(F.lit("p = "), F.format_string("%.2f", p), F.lit(" (not significant)")))


#: The months and years that open a trailing date clause.
_CLAUSE = r"(?i)\s+(by|in|before|on|this|next)\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|q[1-4]|20[0-9][0-9]|[0-9]).*$"
_LEAD = r"(?i)^(will|does|is|are|can|did|has|have|the|a|an)\s+"


def news_query(question: Column) -> Column:
    """A question without its leading verb and its trailing date clause."""
    s = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), "[?]+", " "))
    s = F.regexp_replace(F.regexp_replace(s, _LEAD, ""), _CLAUSE, "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def decode_entities(text: Column) -> Column:
    """Character data and entities of XML as plain text; tags go. Numeric entities up to code point 65,535 are decoded."""
    plain = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    parts = F.split(plain, r"(?=&#[0-9]{1,5};)")

    def numeric(part: Column) -> Column:
        code = F.regexp_extract(part, "^&#([0-9]{1,5});", 1)
        return F.when(code != "", F.concat(F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE"), F.regexp_replace(part, "^&#[0-9]{1,5};", ""))).otherwise(part)

    plain = F.array_join(F.transform(parts, numeric), "")
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("<[^>]+>", "")):
        plain = F.regexp_replace(plain, entity, sign)
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def credibility(source: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    return F.when(s.rlike(OFFICIAL), "official").when(s.rlike(SOCIAL), "social").otherwise("news")


def has_any(text: Column, words) -> Column:
    """Does the lower-cased text contain one of the words?"""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w))
    return found


def cut_text(text: Column, length: int) -> Column:
    """White space made single, at most ``length`` characters; a longer text ends in an ellipsis."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(s) > length, F.concat(F.substring(s, 1, length - 1), F.lit("…"))).otherwise(s)


_NAME = r"[A-Z][A-Za-z0-9_.&'-]+(?:\s+[A-Z][A-Za-z0-9_.&'-]+)*"
PARTIES = rf"({_NAME}\s+v\.?\s+{_NAME})"


def actors(title: Column) -> Column:
    """``X v. Y`` of a title; else the agency if it is named; else the title up to its first colon or dash."""
    both = F.regexp_extract(F.coalesce(title, F.lit("")), PARTIES, 1)
    head = cut_text(F.regexp_extract(F.coalesce(title, F.lit("")), "^([^:—-]*)", 1), 50)
    return F.when(both != "", cut_text(both, 60)).when(F.lower(title).contains("cftc"), "CFTC").when(head != "", head).otherwise("CFTC")


def row_key(source: Column, actors_: Column) -> Column:
    """``cl<docket>`` or ``pr<release>`` from the source's address, else ``actor:<name>``."""
    docket = F.regexp_extract(F.coalesce(source, F.lit("")), r"docket/([0-9]+)/", 1)
    release = F.regexp_extract(F.coalesce(source, F.lit("")), r"\b([0-9]{3,5}-[0-9]{2})\b", 1)
    name = F.trim(F.regexp_replace(F.lower(F.coalesce(actors_, F.lit(""))), r"\s+", " "))
    return F.when(docket != "", F.concat(F.lit("cl"), docket)).when(release != "", F.concat(F.lit("pr"), release)).otherwise(F.concat(F.lit("actor:"), name))


def caption(name: Column) -> Column:
    """White space made single, ``v.`` between parties; a caption all in capitals gets title case but for ``KEEP_CASE``."""
    s = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    loud = s == F.upper(s)
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)\s+v\.?\s+", " v. "), r"(?i)\s+vs\.?\s+", " v. ")
    keep = F.create_map(*(F.lit(x) for pair in KEEP_CASE.items() for x in pair))

    def word(w: Column) -> Column:
        own = F.try_element_at(keep, F.lower(w))
        mixed = w.rlike("[a-z]") & w.rlike("[A-Z]")
        return F.when(F.lower(w) == "v.", "v.").when(own.isNotNull(), own).when(mixed, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))

    return F.when(loud, F.array_join(F.transform(F.split(s, " "), word), " ")).otherwise(s)


def stub_summary(court: Column, docket_number: Column, filed: Column, found_on: Column) -> Column:
    """A summary of nothing but what the docket says."""
    where = F.coalesce(F.nullif(court, F.lit("")), F.lit("an unspecified court"))
    number = F.when(F.coalesce(docket_number, F.lit("")) != "", F.concat(F.lit(" (docket "), docket_number, F.lit(")"))).otherwise("")
    place = F.when(F.coalesce(filed, F.lit("")) != "", F.concat(F.lit("Filed "), filed, F.lit(" in "), where, number, F.lit("."))).otherwise(F.concat(F.lit("Filed in "), where, number, F.lit(".")))
    return F.concat(F.lit("New filing, found on "), found_on, F.lit(". "), place, F.lit(" Merits and posture not yet reviewed."))
