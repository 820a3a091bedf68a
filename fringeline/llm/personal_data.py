"""Personal data in whole texts, with built-in functions only: patterns, and spans added by weak supervision.

Fixed patterns give the base spans, which all stay.  Looser patterns (names by title, given name, words that announce
them or what follows; account numbers by form or announced; local telephone numbers; long tokens and announced
passwords) give further candidates, so what is found need not be in any list.  Labelers vote on each (yes, no or none): one by the match's form, one by gazetteers of names, one by
word lists on what stands before it, one by the words further off, one by the marks before it, and one by the base
spans of the same text.  The counts of vote patterns are few whatever the corpus; expectation-maximisation on them
estimates how reliable each labeler is and how likely each pattern is personal.  A logistic regression on votes, kind,
length and share of digits learns these likelihoods, and decides as an expression on each candidate.

The patterns are possessive and anchored behind other characters of their first class, or where the last match
ended, so that each scans in linear time without recursion; they find the same matches as the plain ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeline.llm.shared import named, opened, whole, written

#: Order of spans that start together.
KINDS = ("email", "ip", "card", "phone", "account", "secret", "name")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
DIGITS = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Ten digits in the usual three parts; other groupings (a leading 0, or three by three) count only where announced.
TEN_DIGITS = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
LOCAL_PHONE = rf"(?<![0-9+(])(?:{TEN_DIGITS}|(?:\(0[0-9]{{1,4}}\) ?|0[0-9]{{1,4}}[ /.-])[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,3}}|[6-9][0-9]{{2}} [0-9]{{3}} [0-9]{{3}})(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{24,}+={0,2}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IN_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}(?:[0-9]{2}(?: ?[A-Z0-9]{1,4})* ?)?$"
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sr|Sra|Señor|Señora|Herr|Frau|Monsieur|Madame|Mme)\.?"
# Phrases that announce a password, an account number or a name, words after a name, capitalised words that begin none.
PASSWORD_IS = r"(?:password|passwd|passphrase|passcode|pwd|pin|secret|token|api[_ -]?key|contraseña|clave|passwort|kennwort|mot de passe)"
ACCOUNT_IS = r"(?iu)(?:account|acct|a/c|iban|routing|konto|kontonummer|kontonr|cuenta|compte)(?: ?(?:number|no|nr|nummer|número|numéro|num|is|ist|es|est|de)\.?){0,3}[\x20:#=.]{0,3}$"
PHONE_IS = r"(?iu)(?<!\p{L})(?:phone|tel|telephone|call|ring|text|fax|mobile|cell|teléfono|telefono|móvil|llame|llámame|telefon|mobil|handy|rufen|téléphone|portable|appelez)(?!\p{L})[^0-9]{0,20}$"
NAME_IS = r"(?:names? is|named|called|signed|signed by|contact|attn|attention|dear|i am|i'm|regards|sincerely|cheers|name|customer|patient|employee|caller|tenant|holder|llamo|nombre es|soy|nombre|firmado|querid[oa]|estimad[oa]|atentamente|heiße|name ist|liebe|lieber|gez\.|ansprechpartner|grüßen|m'appelle|suis|nom est|nom|chère?|signé|cordialement)"
NAME_DOES = r"(?:said|says|wrote|writes|lives|called|emailed|asked|replied|was born|sagte|schrieb|wohnt|dijo|escribió|vive|habite|écrit)"
NO_NAME = "The This That These Those Then When While But And If As So In On At Our Your My His Her Their Customer Support Sales Service Team Human Technical General New Der Die Das Ein Eine Wenn Und Aber El La Los Las Un Una Pero Cuando Le Les Une Mais Quand"
# Words that announce a kind, words that stand near one, and common given names and surnames.
CUES = {
    "phone": "phone tel telephone call ring text fax mobile cell handy teléfono telefono móvil llame llámame telefon mobil rufen téléphone portable appelez",
    "account": "account card iban bic swift acct credit debit visa mastercard cuenta tarjeta konto kontonummer karte compte carte",
    "secret": "token key secret password passwd passphrase passcode pin pwd apikey api credential bearer auth contraseña clave passwort kennwort passe schlüssel clé",
    "name": "name named dear hi hello contact attn signed from by nombre soy querido querida contacto heiße name lieber liebe grüße nom cher chère signé am called regards sincerely cheers attention llamo firmado estimado estimada atentamente gez ansprechpartner grüßen appelle suis cordialement customer patient employee caller tenant holder",
}
NEAR = {
    "phone": "phone contact reach dial office home hotline number extension",
    "account": "bank payment pay transfer billing expires cvv holder balance",
    "secret": "login access authorization header config env export curl git aws",
    "name": "born lives works married employee customer patient teacher student doctor",
}
GIVEN_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Steven Paul Andrew Kevin Brian George Edward Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Nancy Lisa Margaret Betty Sandra Ashley Emily Donna Michelle Carol Amanda Laura Anna Emma Peter Hans Klaus Jürgen Wolfgang Stefan Andreas Martin Monika Ursula Petra Sabine Birgit Heike José Antonio Manuel Francisco Juan Javier "
    "Carlos Miguel Jesús Luis María Carmen Ana Isabel Dolores Pilar Lucía Sofía Jean Pierre Michel André Philippe Jacques François Nicolas Marie Monique Nathalie Isabelle Sylvie Catherine Françoise Camille Maria Jose Jesus Francois Jurgen"
)
SURNAMES = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Green Baker Adams Nelson Hill Campbell Mitchell Roberts Müller Schmidt "
    "Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder García González Rodríguez Fernández López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Muñoz Álvarez "
    "Romero Alonso Gutiérrez Martin Bernard Dubois Thomas Robert Richard Petit Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia David Bertrand Roux Vincent Fournier Morel Girard"
)
WORD = r"\p{Lu}\p{Ll}++"
#: A word of a name: O'Brien, McDonald, Anne-Marie.
PART_OF_NAME = r"\p{Lu}(?:\p{Ll}++|['’]\p{Lu}\p{Ll}++)(?:\p{Lu}\p{Ll}++)?+(?:-\p{Lu}\p{Ll}++)?+"
FURTHER = rf"(?: (?:(?:de|da|di|del|della|van|von|der|den|la|le|el|al|bin|\p{{Lu}}\.) ){{0,2}}{PART_OF_NAME})"
LISTED_NAME = rf"(?:{TITLE}|{'|'.join(GIVEN_NAMES.split())}) {WORD}(?: {WORD})?+"
ANNOUNCED = rf"(?<=(?<!\p{{L}})(?iu:{NAME_IS})\x20?[:,]?[\x20\n])"
ARTICLE = r"(?:(?iu:the|der|die|das|el|la|los|las|le|les)\x20)"
NAME = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{LISTED_NAME}|(?!(?:{'|'.join(NO_NAME.split())})(?!\p{{L}}))(?:{ANNOUNCED}{PART_OF_NAME}{FURTHER}{{1,3}}+|(?<!{ARTICLE})(?<!\p{{Lu}}\p{{Ll}}{{1,15}} ){PART_OF_NAME}{FURTHER}{{1,3}}+(?=,? (?:{NAME_DOES}(?!\p{{L}})|[<(][A-Za-z0-9._%+-]+@))))"
PASSWORD = rf"(?<=[\x20:=\"'])(?<=(?iu:{PASSWORD_IS})\x20{{0,2}}(?:[:=]|is|was|ist|es|est)\x20{{0,2}}[\"']?)[^\s\"'<>,;=:]{{5,63}}[^\s\"'<>,;.:!?()\[\]=]"
LABELERS = ("form", "listed", "cue", "near", "mark", "company")
#: Characters before a match that the labelers see.
LEFT = 48
#: Items of an array that are gone through at once; a scan is linear up to this number times it.
PART = 256


def found(text: Column, pattern: str, guard: str) -> tuple[Column, Column]:
    """Pieces between matches and the matches; one empty piece if the guard, which every match holds, is not in the text."""
    can = F.regexp_like(text, F.lit(guard)) if len(guard) > 1 else F.contains(text, F.lit(guard))
    return F.when(can, F.split(text, pattern, -1)).otherwise(F.array(F.lit(""))), F.when(can, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def scanned(column: str, step, kind: str) -> Column:
    """Of each item of an array column the item x and `before`, an int that starts at 0 and goes on by step(before, x).

    The items are cut into parts; the state before each part comes first, then each part is gone through by itself, so no
    array grows beyond a part's or the parts' number.  The array has to be a column: an expression would be worked out
    again for every part.
    """
    items = F.col(column)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int")), lambda k: F.slice(items, k * PART + 1, PART))
    after = lambda before, part: F.aggregate(part, before, step)
    starts = F.aggregate(parts, F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out")), lambda a, p: F.struct(after(a["s"], p).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")), lambda a: a["out"])
    none = F.array().cast(f"array<struct<before:int,x:{kind}>>")
    each = lambda part, before: F.aggregate(
        part,
        F.struct(before.alias("s"), none.alias("out")),
        lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(F.struct(a["s"].alias("before"), x.alias("x")))).alias("out")),
        lambda a: a["out"],
    )
    return F.when(F.size(items) > 0, F.flatten(F.zip_with(parts, starts, each))).otherwise(none)


def pieced(pieces: str, matches: str) -> Column:
    """Of each match the length of what stands before it, its own, itself, and the last characters before it."""
    return F.zip_with(F.slice(F.col(pieces), F.lit(1), F.size(matches)), F.col(matches), lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("match"), F.right(p, F.lit(LEFT)).alias("left")))


def placed(column: str) -> Column:
    """start, end (code points), match and what stands before it, of each match of a column of pieced()."""
    rows = scanned(column, lambda at, x: at + x["gap"] + x["size"], "struct<gap:int,size:int,match:string,left:string>")
    return F.transform(rows, lambda y: F.struct((y["before"] + y["x"]["gap"]).alias("start"), (y["before"] + y["x"]["gap"] + y["x"]["size"]).alias("end"), y["x"]["match"].alias("match"), y["x"]["left"].alias("left")))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits, at most 19, pass the check; the second from the right and every other one doubled."""
    d = F.reverse(digits_of(match))
    value = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substr(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(value, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def low_parts(match: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(match, r"\."), lambda p: F.when(F.length(bare(p)) <= 3, F.concat(F.lit("0"), bare(p)).cast("int") <= 255).otherwise(False))


def iban_holds(match: Column) -> Column:
    """Whether the number's check digits hold: letters count from 10 on, the first four characters come last, 1 is left of 97."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    value = F.transform(F.split(moved, "(?!^)(?!$)"), lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def long_digits(match: Column, low: int, high: int) -> Column:
    return F.length(digits_of(match)).between(low, high)


def spans_of(docs: DataFrame) -> DataFrame:
    """row (the whole row of docs), base and extra: arrays of (start, rank, end), of extra ones also the votes and features."""
    names = {"email": (EMAIL, "@"), "ip": (IP, r"[0-9]\.[0-9]"), "digits": (DIGITS, "[0-9][\\x20-]?[0-9]"), "phone": (PHONE, "+"), "local": (LOCAL_PHONE, "[0-9][ ./)-]{1,2}[0-9]{2}"), "secret": (SECRET, SECRET), "iban": (IBAN, IBAN), "password": (PASSWORD, f"(?iu){PASSWORD_IS}"), "name": (NAME, NAME)}
    text = F.coalesce(named("text").cast("string"), F.lit(""))
    cols = [c.alias(f"{k}_{side}") for k, (pattern, guard) in names.items() for side, c in zip("pm", found(text, pattern, guard), strict=True)]
    raw = docs.select(whole(docs).alias("row"), *cols).select("row", *(pieced(f"{k}_p", f"{k}_m").alias(k) for k in names)).select("row", *(placed(k).alias(k) for k in names))
    span = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"))
    is_card = lambda x: F.when(long_digits(x["match"], 14, 19), luhn(x["match"])).otherwise(False)
    kept = {
        "email": F.col("email"),
        "ip": F.filter("ip", lambda x: low_parts(x["match"])),
        "card": F.filter("digits", is_card),
        "phone": F.filter("phone", lambda x: long_digits(x["match"], 10, 15)),
    }
    base = F.array_sort(F.concat(*(F.transform(c, span(k)) for k, c in kept.items())))
    bare = lambda x: F.regexp_like(x["match"], F.lit("^[0-9]{6,11}$")) & F.regexp_like(x["left"], F.lit(ACCOUNT_IS))
    own = lambda x: F.when(long_digits(x["match"], 12, 19), ~is_card(x)).otherwise(bare(x)) & ~F.regexp_like(x["left"], F.lit(IN_IBAN))
    coded = lambda x: F.regexp_like(x["match"], F.lit("[0-9]")) & ~F.regexp_like(x["match"], F.lit(f"^{IBAN}$"))  # noqa: E731 a long word is none
    mixed = lambda x: F.regexp_like(x["match"], F.lit(r"[0-9]|\p{L}[^\p{L}.'-]")) & ~F.regexp_like(x["match"], F.lit(SECRET))
    more = [
        ("phone", F.filter("local", lambda x: long_digits(x["match"], 9, 12) & (F.regexp_like(x["match"], F.lit(f"^{TEN_DIGITS}$")) | F.regexp_like(x["left"], F.lit(PHONE_IS)))), None),
        ("account", F.filter("digits", own), None),
        ("account", F.col("iban"), "iban"),
        ("secret", F.filter("secret", coded), None),
        ("secret", F.filter("password", mixed), "password"),
        ("name", F.col("name"), None),
    ]
    based = raw.withColumn("base", base)
    company = F.when(F.size("base") > 0, 1).otherwise(0)
    some = based.select("row", "base", F.concat(*(F.transform(c, candidate(k, company, source)) for k, c, source in more)).alias("extra"))
    return apart(some).select("row", "base", "extra")


#: Pairs of base spans and candidates of a text that are compared one by one.
PAIRS = 4096
BIG = (1 << 31) - 1


def apart(rows: DataFrame) -> DataFrame:
    """rows without the extra spans that overlap a base span.

    Where there are many of both, one pass from either side over all spans in order tells; each step is a column of its own.
    """
    kind = "struct<start:int,own:int,end:int,nr:int>"
    many = F.size("base").cast("long") * F.size("extra") > PAIRS
    of = lambda spans, own: F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), i.alias("nr")))
    rows = rows.withColumn("both", F.when(many, F.array_sort(F.concat(of("base", 0), of("extra", 1)))).otherwise(F.array().cast(f"array<{kind}>")))
    rows = rows.withColumn("back", F.reverse("both"))
    ended = scanned("both", lambda at, x: F.when(x["own"] == 0, F.greatest(at, x["end"])).otherwise(at), kind)  # the furthest end of base spans that start no later
    begun = scanned("back", lambda at, x: F.when(x["own"] == 0, F.greatest(at, BIG - x["start"])).otherwise(at), kind)  # from the nearest start of those that start later
    bad = lambda found, hit: F.transform(F.filter(found, lambda y: (y["x"]["own"] == 1) & hit(y)), lambda y: F.struct(y["x"]["nr"].alias("nr"), F.lit(0).alias("own")))
    hits = F.concat(bad(ended, lambda y: y["before"] > y["x"]["start"]), bad(begun, lambda y: BIG - y["before"] < y["x"]["end"]))
    rows = rows.withColumn("marks", F.when(many, F.array_sort(F.concat(hits, F.transform("extra", lambda x, i: F.struct(i.alias("nr"), F.lit(1).alias("own")))))).otherwise(F.array().cast("array<struct<nr:int,own:int>>")))
    rest = scanned("marks", lambda at, x: F.when(x["own"] == 0, x["nr"] + 1).otherwise(at), "struct<nr:int,own:int>")  # a hit stands before its span
    some = F.transform(F.filter(rest, lambda y: (y["x"]["own"] == 1) & (y["before"] != y["x"]["nr"] + 1)), lambda y: F.get("extra", y["x"]["nr"]))
    each = F.filter("extra", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.withColumn("extra", F.when(many, some).otherwise(each)).drop("both", "back", "marks")


def candidate(kind: str, company: Column, source: str | None = None):
    """Span, votes (1, -1, or 0 for none) and features of a match; source: the pattern, where a kind has several."""

    def of(x: Column) -> Column:
        digits, size = F.length(digits_of(x["match"])), F.length(x["match"])
        if source == "iban":
            form = F.when(iban_holds(x["match"]), 1).otherwise(0)
        elif source == "password":
            form = F.lit(1)
        elif kind == "secret":
            form = F.when((size >= 32) & (digits < size), 1).otherwise(0)
        elif kind == "account":
            form = F.when(size < 12, 1).otherwise(0)  # shorter ones are candidates only where announced
        else:
            form = F.lit(1)
        if kind == "name":
            parts = F.split(F.regexp_replace(x["match"], f"^{TITLE} ", ""), " ")
            listed = F.when(F.get(parts, F.lit(0)).isin(GIVEN_NAMES.split()) | F.element_at(parts, -1).isin(SURNAMES.split()), 1).otherwise(0)
        else:
            listed = F.lit(0)
        before = F.filter(F.split(F.lower(x["left"]), r"[^\p{L}]+"), lambda w: w != "")
        cue = F.when(F.exists(F.slice(before, F.greatest(F.lit(1), F.size(before) - 2), 3), lambda w: w.isin(CUES[kind].split())), 1).otherwise(-1 if kind == "account" and source is None else 0)  # a bare number may be anything
        near = F.when(F.exists(before, lambda w: w.isin(NEAR[kind].split())), 1).otherwise(0)
        if kind == "name":  # neither listed nor announced: what follows has brought it
            known = F.regexp_like(x["match"], F.lit(f"^{LISTED_NAME}"))
            near = F.when(~known & (cue == 0), 1).otherwise(near)
        mark = F.when(F.regexp_like(x["left"], F.lit(r"[:=#(][\x20]?[\"']?$")), 1).otherwise(-1 if kind == "secret" else 0)
        votes = {"form": form, "listed": listed, "cue": cue, "near": near, "mark": mark, "company": company}
        return F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), *(votes[c].cast("int").alias(c) for c in LABELERS),
            F.least(F.lit(3), F.floor(size / 12)).cast("int").alias("long"), F.floor(3 * digits / size).cast("int").alias("digits"),
        )

    return of


PATTERN = ("rank", *LABELERS, "long", "digits")


#: Chance of a vote no, none and yes of a labeler, of what is personal and what is not, before anything is seen; and its
#: weight as a part of all candidates, which keeps the two classes from changing places.
BELIEF = np.array([[0.4, 0.5, 0.1], [0.1, 0.5, 0.4]])
ANCHOR = 0.25


def estimated(votes: np.ndarray, count: np.ndarray, steps: int = 60) -> np.ndarray:
    """Likelihood that each vote pattern is personal, by expectation-maximisation over the labelers' reliabilities."""
    n, m = votes.shape
    prior = 0.5
    chance = np.repeat(BELIEF[:, None, :], m, 1)  # of each vote, in either class
    weight = ANCHOR * count.sum()
    q = np.full(n, 0.5)
    for _ in range(steps):
        like = [np.log(p) + sum(np.log(chance[y, j, votes[:, j] + 1]) for j in range(m)) for y, p in ((0, 1 - prior), (1, prior))]
        q = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        for y, share in ((0, (1 - q) * count), (1, q * count)):
            for j in range(m):
                chance[y, j] = (np.bincount(votes[:, j] + 1, share, 3) + weight * BELIEF[y]) / (share.sum() + weight)
        prior = ((q * count).sum() + weight / 2) / (count.sum() + weight)
    return q


def features(pattern: np.ndarray) -> np.ndarray:
    m = len(LABELERS)
    rank, votes, long, digits = pattern[:, 0], pattern[:, 1 : 1 + m], pattern[:, 1 + m], pattern[:, 2 + m]
    return np.concatenate([rank[:, None] == np.arange(len(KINDS)), votes == 1, votes == -1, long[:, None] == np.arange(4), digits[:, None] == np.arange(4)], 1).astype(float)


def classifier(extra: DataFrame, steps: int = 400) -> list[float]:
    """Weights of the span classifier, from the counts of the candidates' patterns (a bounded number)."""
    rows = extra.select(F.explode("extra").alias("x")).groupBy(*(F.col(f"x.{c}").alias(c) for c in PATTERN)).count().collect()
    if not rows:
        return []
    rows = sorted(tuple(r) for r in rows)
    pattern, count = np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows], float)
    target = estimated(pattern[:, 1 : 1 + len(LABELERS)], count)
    x, weight = features(pattern), np.zeros(len(features(pattern)[0]))
    share = count / count.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ weight))
        weight -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(weight)), x.T @ (share * (p - target)) + 1e-3 * weight)
        if np.abs(x.T @ (share * (p - target)) + 1e-3 * weight).max() < 1e-9:
            break
    return weight.tolist()


def accepted(weight: list[float]) -> Column:
    """Candidates that the classifier takes for personal, as spans."""
    k, m = len(KINDS), len(LABELERS)

    def logit(x: Column) -> Column:
        pick = lambda c, values: sum((F.when(c == v, w).otherwise(0.0) for v, w in values), F.lit(0.0))
        out = pick(x["rank"], list(enumerate(weight[:k])))
        for j, name in enumerate(LABELERS):
            out = out + pick(x[name], [(1, weight[k + j]), (-1, weight[k + m + j])])
        return out + pick(x["long"], list(enumerate(weight[k + 2 * m : k + 2 * m + 4]))) + pick(x["digits"], list(enumerate(weight[k + 2 * m + 4 : k + 2 * m + 8])))

    if not weight:
        return F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return F.transform(F.filter("extra", lambda x: logit(x) >= math.log(1.0)), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans of every row.

    Null and empty texts hold nothing; a null doc_id stays null; repeated rows give repeated results; very long texts are
    searched whole; other columns are ignored; an empty table gives no rows.  The counts of kinds and the digest are of base
    spans; spans lists those and the accepted candidates, which overlap no base span, and n_spans counts them all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(spans_of(rows).select(F.col("row.doc_id").alias("doc_id"), "base", "extra"), "spans")
    weight = classifier(rows)
    of_rank = lambda i: F.size(F.filter("base", lambda b: b["rank"] == i)).cast("long")
    count = [of_rank(i).alias(f"n_{KINDS[i]}") for i in range(4)]
    every = F.array_sort(F.concat("base", accepted(weight)))
    return rows.select("doc_id", *count, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


#: Characters of the blocks in which a text is cut up for redaction, so that a part is taken without passing the whole.
BLOCK = 1024


def part_of(blocks: str, start: Column, end: Column) -> Column:
    """Characters [start, end) of the text that the blocks make up."""
    first = F.floor(start / BLOCK).cast("int")
    own = F.array_join(F.slice(F.col(blocks), first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substr(own, start - first * BLOCK + 1, end - start)).otherwise("")


def redacted(docs: DataFrame) -> DataFrame:
    """docs, all columns, with each span of the text (overlapping ones together) replaced by its first kind in angle brackets.

    Null and empty texts stay as they are; repeated rows are changed alike; a table without rows gives none; columns keep
    their names and order whatever they are, only text is changed (and made a string).
    """
    found = written(spans_of(docs), "spans")
    rows = found.withColumn("spans", F.array_sort(F.concat("base", accepted(classifier(found))))).withColumn("text", F.col("row").getField("text").cast("string"))
    rows = rows.withColumn("blocks", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("steps", scanned("spans", lambda at, x: F.greatest(at, x["end"]), "struct<start:int,rank:int,end:int>"))
    kinds = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    shown = lambda y: F.when(y["x"]["start"] < y["before"], "").otherwise(F.concat(part_of("blocks", y["before"], y["x"]["start"]), F.element_at(kinds, y["x"]["rank"] + 1)))
    last = F.array_max(F.transform("spans", lambda x: x["end"]))
    done = F.concat(F.array_join(F.transform("steps", shown), ""), part_of("blocks", last, F.length("text")))
    return opened(rows, docs.columns, text=F.when(F.size("spans") > 0, done).otherwise(F.col("text")))
