"""Labels of people and organisations, linked to the entity they name.

A noisy channel: some spelling of an entity is its canonical form, and a stored label is that
form sent through changes of order, case, accents, titles, short forms, initials, abbreviations
and typing errors. Labels that differ only by changes the channel makes freely (order, case,
accents, titles, decoration, damaged characters) fall into one spelling class; the frequency
of a class is its prior. Every class is then attached to the one class that maximises prior
times the likelihood of the remaining changes, if that beats standing on its own; following
the attachments leads to the entity.

Candidates come from exact joins on keys (all parts but one, and the odd part with one letter
deleted), so nothing is compared with everything and no candidate list is cut.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from chatterloom.functions.plan import checkpointed
from chatterloom.llm.encoding import restore
from chatterloom.llm.lookalike import skeleton

#: Words before a name that are not part of it (fixed values).
TITLES = set("dr prof professor mr mrs ms miss mx sir coach frau herr señor señora senor senora sr sra dona mme mlle monsieur madame pani hanim the".split())
#: Legal forms and decorations of organisations (fixed values).
LEGAL = set("ltd limited gmbh inc co company plc llc ag sa srl team official and".split())
#: Short forms of given names that no rule of :func:`clipped` gives, and the names they may stand for.
SHORT_FORMS = {
    "bob": "robert", "bobby": "robert", "bert": "robert albert herbert hubert gilbert", "bill": "william", "billy": "william", "liam": "william", "dick": "richard", "rick": "richard frederick", "jack": "john jackson",
    "jim": "james", "jimmy": "james", "jamie": "james", "hank": "henry", "harry": "henry harold harriet", "hal": "henry harold", "ted": "edward theodore", "teddy": "edward theodore", "ned": "edward edmund", "nell": "eleanor helen",
    "chuck": "charles", "charlie": "charles charlotte", "dave": "david", "davy": "david", "steve": "stephen steven", "mike": "michael", "mick": "michael", "mikey": "michael", "mitch": "mitchell", "tony": "anthony antonio", "larry": "lawrence",
    "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "greta": "margaret margareta", "daisy": "margaret", "polly": "mary", "molly": "mary", "kate": "katherine catherine kathryn", "katie": "katherine catherine kathryn",
    "kitty": "katherine catherine", "kit": "christopher katherine", "katia": "yekaterina katarina", "katya": "yekaterina katarina", "betty": "elizabeth", "betsy": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "libby": "elizabeth", "eliza": "elizabeth",
    "sue": "susan susannah suzanne", "susie": "susan susannah suzanne", "suzie": "susan susannah suzanne", "susan": "susannah", "sally": "sarah", "sadie": "sarah", "nancy": "anne ann", "nan": "anne nancy", "becky": "rebecca", "bex": "rebecca", "trish": "patricia", "patty": "patricia",
    "debs": "deborah", "hattie": "harriet", "hatty": "harriet", "etta": "henrietta harriet", "izzy": "isabel isidora isobel", "dorie": "isidora dorothy", "dot": "dorothy", "dolly": "dorothy", "lenny": "leonard leonardo", "archie": "archibald", "zak": "zachary", "zack": "zachary",
    "cordy": "cordelia", "ronnie": "ronald veronica", "ron": "ronald", "vera": "veronica", "flip": "philippa philip", "pip": "philippa philip", "pippa": "philippa", "stacey": "anastasia", "stacy": "anastasia", "nastya": "anastasia", "sasha": "alexander alexandra", "xander": "alexander", "topher": "christopher", "vicky": "victoria", "penny": "penelope",
    "gosia": "malgorzata", "malgosia": "malgorzata", "aga": "agnieszka", "agnes": "agnieszka", "kasia": "katarzyna", "luki": "lukasz", "olu": "oluwaseun oluwaseyi", "dima": "dimitrios dmitri dmitry", "dimi": "dimitrios", "mitsos": "dimitrios", "dimitris": "dimitrios", "slava": "vladislav vyacheslav", "vladik": "vladislav",
    "volodya": "vladimir", "misha": "mikhail", "kolya": "nikolai", "vanya": "ivan", "tanya": "tatiana", "pepe": "jose", "paco": "francisco", "pancho": "francisco", "nacho": "ignacio", "iggy": "ignacio", "lupita": "guadalupe", "lola": "dolores", "quique": "enrique", "kiko": "francisco yukiko",
    "joca": "joao", "ze": "jose", "zezinho": "jose", "sao": "conceicao", "nao": "noemie naomi", "mimi": "noemie miriam", "hans": "johannes", "hannes": "johannes", "uschi": "ursula", "ursi": "ursula", "jupp": "joseph josef", "sepp": "joseph josef", "joe": "joseph", "joey": "joseph",
    "tom": "thomas", "tommy": "thomas", "tori": "victoria", "dina": "konstantina", "della": "adela cordelia", "jo": "johannes joanna josephine joseph", "memo": "mehmet", "mem": "mehmet", "ibo": "ibrahim", "ibs": "ibrahim", "baldie": "archibald", "thea": "theodora dorothea", "theo": "theodore theodora", "leo": "leonardo leonard", "leon": "leonardo leonard", "dom": "dominic", "nic": "nicholas dominic", "nico": "nicholas", "nick": "nicholas", "nicky": "nicholas nicola", "zo": "zoe", "clo": "chloe",
}
#: Names that are short for another and as often somebody's whole name.
OWN_NAMES = set("liam susan agnes greta leo leon nancy molly sally daisy jack harry stacey eliza theo thea mitch vera hans".split())
_FULL = {}
for _short, _names in SHORT_FORMS.items():
    for _name in _names.split():
        _FULL.setdefault(_name, set()).add(_short)
#: Log likelihoods of the changes the channel makes.
LOG_TYPO, LOG_INITIAL, LOG_NICK, LOG_DROP, LOG_ABBR = math.log(0.02), math.log(0.1), math.log(0.1), math.log(0.05), math.log(0.1)
#: Beta priors of the chance that a short form used with a surname is that surname's full name:
#: for short forms, and for those that are as often a name of their own.
SHORT_PRIOR, OWN_PRIOR = (4.0, 1.0), (0.2, 2.0)
#: Log odds against two frequent spellings one error apart being one entity by chance alone.
LOG_CHANCE = math.log(1e-7)
#: Two forms are two names where the rarer is surely used in over this share of the commoner's
#: classes; how sure, in standard errors, so that few classes never decide it.
COMMON, SURE = 0.3, 1.645

_SPECIAL = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ı": "i", "æ": "ae", "Æ": "Ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d"})
_TAIL = re.compile(r"(?i)\s*(?:[-–]\s*new (?:number|phone)|\((?:work|team|home|new|mobile|office|private|old)\)|\b(?:official|team)|\s\d{1,3})\s*$")
_DROP = re.compile(r"[^\w\s.,&'’\-]|[\d_]")


def _plain(text: str) -> str:
    t = unicodedata.normalize("NFD", text.translate(_SPECIAL))
    return "".join(c for c in t if not unicodedata.combining(c))


def parse(label: str) -> tuple[list[str], str | None]:
    """Parts of a label in sorted order, and its initial if a part is only an initial. The parts
    are free of order, case, accents, titles and decoration; a part with a dot behind it keeps it,
    as it is an abbreviation."""
    t = skeleton(restore(label)[0]).strip(" ~")
    while (u := _TAIL.sub("", t)) != t:
        t = u
    t = _DROP.sub(" ", _plain(t)).replace("_", " ")
    t = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t) if " " not in t.strip() else t
    raw = [w for w in re.split(r"[\s,]+|(?<=[^\W\d_]{2})\.(?=[^\W\d_]{2})", t) if w.strip(".'’-&")]
    words, initials = [], []
    for w in raw:
        bare = w.strip(".'’-&").casefold()
        if not bare or bare in TITLES or bare in LEGAL:
            continue
        if len(bare) == 1:
            initials.append(bare)
        else:
            words.append(bare + "." if w.endswith(".") else bare)
    if not words:
        digits = "".join(c for c in label if c.isdigit())
        # a blank before it: never the parts of another label
        return sorted(initials) or (["#" + digits] if len(digits) > 5 else [" " + label]), None
    return sorted(words), (initials[0] if initials and len(words) == 1 else None)


@F.pandas_udf(StructType([StructField("parts", ArrayType(StringType())), StructField("initial", StringType())]))
def _parse_udf(labels: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x) for x in labels], columns=["parts", "initial"])


def one_typo(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns ``a`` into ``b``."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or len(b) < 3:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def shared_cut(a: str, b: str) -> bool:
    """Whether both are one error away from some third spelling they share by one deletion each."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 5:
        return False
    cuts = {a, *(a[:i] + a[i + 1 :] for i in range(len(a)))}
    return b in cuts or any(b[:i] + b[i + 1 :] in cuts for i in range(len(b)))


def clipped(x: str, y: str) -> bool:
    """Whether one is the other cut short at either end, or cut short with an ending of endearment."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < 2 or x == y:
        return False
    if y.startswith(x) or (len(x) > 3 and y.endswith(x)):
        return True
    stem = re.sub("(?:ie|ey|y|i|e|a|o|s)$", "", x)
    stem = stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] else stem
    return len(stem) >= 2 and len(x) >= 3 and y.startswith(stem)


def short_form(x: str, y: str) -> bool:
    """Whether the table has one as short for the other, or both for one name."""
    a, b = SHORT_FORMS.get(x, "").split(), SHORT_FORMS.get(y, "").split()
    return x in b or y in a or bool(set(a) & set(b))


def abbreviates(x: str, y: str) -> bool:
    """Whether ``x`` is ``y`` cut and dotted, or ``y`` without its vowels, or ``y`` cut (with an s)."""
    bare = x.rstrip(".")
    if len(bare) < 2 or len(bare) >= len(y) or bare[0] != y[0]:
        return False
    if y.startswith(bare) or (x.endswith(".") and y.startswith(bare[:-1]) and len(bare) > 3):
        return True
    if len(bare) >= 3 and not re.search("[aeiou]", bare[1:]):
        return re.match(".*?".join(map(re.escape, bare)), y) is not None
    return len(bare) >= 4 and bare.endswith("s") and y.startswith(bare[:-1])


def likelihood(a: list[str], ai: str | None, b: list[str], bi: str | None) -> tuple[float, str, str, str] | None:
    """``(log likelihood, rule, x, y)`` that parts ``b`` came out as ``a``; None where the channel
    cannot do it. ``rule`` is ``clip`` or ``short`` where the parts ``x`` and ``y`` of the two are
    forms of one name by that rule; their use elsewhere then decides as well."""
    a, b = list(a), list(b)
    if ai is not None and bi is not None:
        return (LOG_TYPO, "", "", "") if ai == bi and one_typo(a[0], b[0]) else None
    if ai is not None or bi is not None:
        short, i, full = (a, ai, b) if ai is not None else (b, bi, a)
        best = None
        for k, s in enumerate(full):
            if one_typo(s, short[0]) and any(g[0] == i for g in full[:k] + full[k + 1 :]) and len(full) == 2:
                v = LOG_INITIAL + (0.0 if s == short[0] else LOG_TYPO)
                best = v if best is None else max(best, v)
        return None if best is None else (best, "", "", "")
    left, right = _apart(a, b)
    if len(left) == len(right) == 1:
        x, y = left[0], right[0]
        if x.rstrip(".") == y.rstrip("."):
            return 0.0, "", "", ""
        if one_typo(x.rstrip("."), y.rstrip(".")):
            return LOG_TYPO, "", "", ""
        if len(a) >= 2 and short_form(x, y):
            return LOG_NICK, "short", x, y
        if len(a) >= 2 and (("." in x and abbreviates(x, y)) or ("." in y and abbreviates(y, x)) or (not re.search("[aeiou]", min(x, y, key=len)[1:]) and (abbreviates(x, y) or abbreviates(y, x)))):
            return LOG_ABBR, "", "", ""
        if len(a) >= 2 and clipped(x, y):
            return LOG_NICK, "clip", x, y
        if shared_cut(x, y):
            return 2 * LOG_TYPO, "", "", ""
    same = [w for w in a if w in b]
    for few, many in ((left, right), (right, left)):  # initials of several words: CC for Cycling Club
        k = len(many)
        if len(few) == 1 and (k >= 3 or (k == 2 and same)) and sorted(few[0].replace(".", "")) == sorted(w[0] for w in many):
            return LOG_DROP, "", "", ""
    if not left and len(right) == 1 and len(a) >= 2 or not right and len(left) == 1 and len(b) >= 2:
        return LOG_DROP, "", "", ""
    if same and max(len(a), len(b)) >= 3 and left and right:
        return _aligned(left, right)
    if len(a) == len(b) == 2 and len(left) == len(right) == 2:  # a form of the first name and a typing error
        for x, u in ((a[0], a[1]), (a[1], a[0])):
            for y, v in ((b[0], b[1]), (b[1], b[0])):
                if one_typo(u, v) and short_form(x, y):
                    return LOG_NICK + LOG_TYPO, "short", x, y
                if one_typo(u, v) and min(len(x), len(y)) >= 3 and clipped(x, y):
                    return LOG_NICK + LOG_TYPO, "clip", x, y
    return None


def _apart(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """What each has that the other has not, counting repeats."""
    left, right = list(a), list(b)
    for w in a:
        if w in right:
            left.remove(w)
            right.remove(w)
    return left, right


def _aligned(left: list[str], right: list[str]) -> tuple[float, str, str, str] | None:
    """Words of one set against their abbreviations in the other; one word may be left out."""
    few, many = sorted((left, right), key=len)
    if len(many) - len(few) > 1:
        return None
    rest, cost = list(many), 0.0
    for w in few:
        hit = next((y for y in rest if abbreviates(w, y) or abbreviates(y, w)), None)
        typo = next((y for y in rest if one_typo(w, y)), None) if hit is None else None
        if hit is None and typo is None:
            return None
        cost += LOG_ABBR if hit is not None else LOG_TYPO
        rest.remove(hit if hit is not None else typo)
    return cost + LOG_DROP * len(rest), "", "", ""


@F.pandas_udf(StructType([StructField("ll", DoubleType()), StructField("rule", StringType()), StructField("x", StringType()), StructField("y", StringType())]))
def _likelihood_udf(a: pd.Series, ai: pd.Series, b: pd.Series, bi: pd.Series) -> pd.DataFrame:
    out = [likelihood(p, i, q, j) or (None, None, None, None) for p, i, q, j in zip(a, ai, b, bi)]
    return pd.DataFrame(out, columns=["ll", "rule", "x", "y"])


_likelihood_udf = _likelihood_udf.asNondeterministic()  # or its filter would run it twice


def _keys(parts: list[str], initial: str | None, rare: list[str]) -> list[str]:
    """Blocking keys; two classes one change apart share at least one. ``rare`` are the parts that
    few classes have: abbreviated words meet under them."""
    if not any(c.isalpha() for p in parts for c in p):  # numbers and signs are themselves or nothing
        return []
    out = set()
    bare = [w.rstrip(".") for w in parts]

    def cut(w: str) -> list[str]:
        return [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))] if len(w) >= 3 else [w]

    if initial is not None:
        return sorted({f"i|{initial}|{c}" for c in cut(bare[0])})
    for i, w in enumerate(bare):
        others = bare[:i] + bare[i + 1 :]
        rest = " ".join(others)
        out |= {f"t|{rest}|{c}" for c in cut(w)}
        if others:
            out |= {f"n|{rest}|{f}" for f in {w, *SHORT_FORMS.get(w, "").split()} if f in _FULL}
            out |= {f"b|{rest}|{w[:2]}", f"e|{rest}|{w[-3:]}"}
        if len(bare) >= 3:
            out.add(f"d|{rest}")
        if 3 <= len(w) <= 5 and len(bare) == 1:
            out.add(f"a|{''.join(sorted(w))}")
        if parts[i] in rare and others:  # the initials of the other words, and all but one of them
            letters = sorted(others[0]) if len(others) == 1 and len(others[0]) <= 3 else sorted(x[0] for x in others)
            out |= {f"m|{w}|{''.join(letters)}", f"m|{w}|{''.join(sorted(x[0] for x in others))}"}
            out |= {f"m|{w}|{''.join(sorted(x[0] for x in others[:k] + others[k + 1 :]))}" for k in range(len(others)) if len(others) > 1}
    if len(bare) >= 2:
        out.add("d|" + " ".join(bare))
    if len(bare) >= 3:
        out.add(f"a|{''.join(sorted(w[0] for w in bare))}")
    if len(bare) == 2:
        for s, g in (bare, bare[::-1]):
            out |= {f"i|{g[0]}|{c}" for c in cut(s)}
            out |= {k for c in cut(s) for k in (f"p|{g[:3]}|{c}", f"s|{g[-3:]}|{c}")} if len(g) > 2 else set()
            out |= {f"q|{f}|{c}" for c in cut(s) for f in {g, *SHORT_FORMS.get(g, "").split()} if f in _FULL}
    return sorted(out)


@F.pandas_udf(ArrayType(StringType()))
def _keys_udf(parts: pd.Series, initial: pd.Series, rare: pd.Series) -> pd.Series:
    return pd.Series([_keys(list(p), i, list(r)) for p, i, r in zip(parts, initial, rare)])


_keys_udf = _keys_udf.asNondeterministic()  # or the filter of the explode would run it twice


def _at_least(share: Column, n: Column) -> Column:
    """Lower end of the Wilson interval of a share of ``n`` counts."""
    z2 = SURE * SURE
    spread_ = F.sqrt(share * (1 - share) / n + F.lit(z2 / 4) / (n * n))
    return (share + F.lit(z2 / 2) / n - F.lit(SURE) * spread_) / (1 + F.lit(z2) / n)


def link(labels: DataFrame, name: str = "name", n: str = "n") -> DataFrame:
    """``name, entity`` of every distinct label; labels of one entity share ``entity``.

    ``labels`` has one row per distinct non-empty string and how often it occurs. A label
    without any letter is an entity of its own. Ties of likelihood go to the more frequent,
    then the smaller class key.
    """
    parsed = labels.select(F.col(name).alias("name"), F.col(n).alias("n")).withColumn("p", _parse_udf("name"))
    parsed = parsed.select("name", "n", "p.parts", "p.initial").withColumn(
        "cls", F.concat_ws(" ", "parts", F.concat(F.lit("|"), "initial"))
    )
    parsed = checkpointed(parsed)
    classes = parsed.groupBy("cls").agg(F.first("parts").alias("parts"), F.first("initial").alias("initial"), F.sum("n").alias("freq"))
    use = classes.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("uses"))
    each = classes.select(F.col("cls").alias("rcls"), F.explode("parts").alias("rpart"))
    # words that may be cut ones come last; of the others those about as rare as the rarest
    cut = (F.length("rpart") <= 4) | ~F.col("rpart").rlike("[aeiou].*[^.]$")
    sorted_ = each.join(use, F.col("rpart") == F.col("part")).groupBy("rcls").agg(
        F.array_sort(F.collect_list(F.struct(cut.alias("cut"), "uses", "rpart"))).alias("r")
    )
    first = F.col("r")[0]
    near = F.filter("r", lambda x: (x["cut"] == first["cut"]) & (x["uses"] <= 2 * first["uses"] + 1))
    rarest = sorted_.select("rcls", F.transform(near, lambda x: x["rpart"]).alias("rare"))
    keyed = classes.join(rarest, F.col("cls") == F.col("rcls")).withColumn("key", F.explode(_keys_udf("parts", "initial", "rare"))).drop("rcls", "rare")
    # keys held by one class alone lead nowhere and go before the join
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("skey"))
    keyed = keyed.join(shared, F.col("key") == F.col("skey"), "left_semi")
    a = keyed.select("key", F.col("cls").alias("ca"), F.col("parts").alias("pa"), F.col("initial").alias("ia"), F.col("freq").alias("fa"))
    b = keyed.select(F.col("key").alias("kb"), F.col("cls").alias("cb"), F.col("parts").alias("pb"), F.col("initial").alias("ib"), F.col("freq").alias("fb"))
    # a class may only attach to a higher one: full before initial, then frequent, then smaller key
    rank_a = F.struct(F.col("ia").isNull().cast("int"), F.col("fa"), F.col("ca"))
    rank_b = F.struct(F.col("ib").isNull().cast("int"), F.col("fb"), F.col("cb"))
    pairs = a.join(b, (F.col("key") == F.col("kb")) & (rank_a < rank_b)).dropDuplicates(["ca", "cb"])
    scored = pairs.withColumn("s", _likelihood_udf("pa", "ia", "pb", "ib")).where("s.ll is not null").select("*", "s.*")
    # two forms both in common use with other surnames are two names, not one clipped
    ux, uy = use.toDF("px", "ux"), use.toDF("py", "uy")
    scored = scored.join(ux, F.col("x") == F.col("px"), "left").join(uy, F.col("y") == F.col("py"), "left")
    rare, total = F.least("ux", "uy"), F.col("ux") + F.col("uy")
    both = (F.col("rule") == "clip") & (_at_least(rare / total, total) > F.lit(COMMON / (1 + COMMON)))
    # a short form: in how many of the classes that have it does the full name go with the same rest
    met = scored.where("rule = 'short'").groupBy(F.least("x", "y").alias("mx"), F.greatest("x", "y").alias("my")).agg(F.count_distinct("ca").alias("met"))
    scored = scored.join(met, (F.least("x", "y") == F.col("mx")) & (F.greatest("x", "y") == F.col("my")), "left")
    own = F.col("x").isin(*OWN_NAMES) | F.col("y").isin(*OWN_NAMES)
    hit, miss = (F.when(own, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(OWN_PRIOR, SHORT_PRIOR))
    stands = (F.col("met") + hit) / (F.greatest(rare, F.col("met")) + hit + miss)
    apart = (F.col("rule") == "short") & (F.log(stands / (1 - stands)) + F.least(F.lit(1.5), F.log("fb") - F.log("fa")) < 0)
    scored = scored.where(~F.coalesce(both, F.lit(False)) & ~F.coalesce(apart, F.lit(False)))
    posterior = F.log("fb") + F.col("ll")
    alone = F.log("fa") + F.lit(LOG_CHANCE)
    best = scored.where(posterior > alone).groupBy("ca").agg(F.max(F.struct(posterior.alias("s"), F.col("fb"), F.col("cb"))).alias("m"))
    parent = best.select("ca", F.col("m.cb").alias("up"))
    root = classes.select("cls").join(parent, F.col("cls") == F.col("ca"), "left").select("cls", F.coalesce("up", "cls").alias("up"))
    root = checkpointed(root)
    while True:  # pointer jumping: the length of a chain halves every round
        jump = root.select(F.col("cls").alias("jc"), F.col("up").alias("ju"))
        step = root.join(jump, F.col("up") == F.col("jc")).select("cls", F.col("ju").alias("up"), (F.col("ju") != F.col("up")).alias("moved"))
        step = checkpointed(step)
        moved = step.where("moved").limit(1).count()
        root = step.select("cls", "up")
        if not moved:
            break
    return parsed.join(root, "cls").select("name", F.col("up").alias("entity"))


def aliases_found(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """``name_a, name_b``: every two distinct labels of one entity, in code-point order."""
    both = messages.select(F.col("sender").alias("name")).unionByName(pairs.select(F.col("who").alias("name")))
    labels = both.where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    linked = link(labels)
    a, b = linked.toDF("name_a", "ea"), linked.toDF("name_b", "eb")
    return a.join(b, (F.col("ea") == F.col("eb")) & (F.col("name_a") < F.col("name_b"))).select("name_a", "name_b")
