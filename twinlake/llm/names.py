"""Variant spellings of names typed by people: performers and albums."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.llm.groups import connected_groups, node_id
from twinlake.session import cut

# Names that stand for nobody or for many.
PLACEHOLDERS = {
    "", "va", "v a", "various", "various artists", "various artist", "varios artistas", "diverse", "diverse interpreten", "verschiedene interpreten",
    "unknown", "unknown artist", "unknown album", "unbekannt", "unbekannter interpret", "unbekanntes album", "desconocido", "artista desconocido",
    "album desconocido", "artist", "album", "untitled", "untitled album", "no artist", "no title", "none", "null", "nan", "n a", "na", "tba", "compilation", "misc", "other", "test",
}
# Words between two performers of one credit.
JOINED = re.compile(r"(?:^|\s)\(?(?:feat|ft|featuring|with|vs|versus|meets|presents|pres)\.?\s|\s(?:x|mit|con)\s|[;/|]")
# Words that carry no identity, with spellings in use.
CONNECTORS = {"the", "th", "and", "und", "of", "from", "frm", "a", "y", "et", "der", "die", "das", "el", "la", "los"}
QUALIFIERS = {"band", "group", "artist", "musician", "singer", "music", "album", "orchestra group"}
# Numerals in names.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
SIZES = {"3": "trio", "4": "quartet", "5": "quintet", "6": "sextet", "8": "octet"}
VOLUMES = {"vol", "volume", "v", "pt", "part", "disc", "cd"}
# Short forms of given names, each with the names it stands for.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander alexandra", "andy": "andrew andres", "ann": "anna anne", "annie": "anna anne", "ben": "benjamin", "bella": "isabella", "bert": "albert robert", "beth": "elizabeth",
    "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher christine",
    "chuck": "charles", "dan": "daniel", "danny": "daniel", "dave": "david", "dick": "richard", "don": "donald", "ed": "edward edmund", "eddie": "edward", "eliza": "elizabeth", "ellie": "eleanor",
    "fran": "frances", "frank": "francis franklin", "fred": "frederick", "gabby": "gabriella", "gabi": "gabriella", "gina": "regina", "greg": "gregory", "hal": "henry", "hank": "henry", "harry": "henry harold",
    "jack": "john", "jake": "jacob", "jamie": "james", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph", "josie": "josephine", "jo": "josephine",
    "kate": "katherine catherine", "kathy": "katherine", "katie": "katherine", "kit": "christopher", "larry": "lawrence lorenzo", "liz": "elizabeth", "lizzie": "elizabeth", "lou": "louis louise", "maggie": "margaret",
    "mandy": "amanda", "matt": "matthew", "meg": "margaret", "mick": "michael", "mike": "michael", "molly": "mary", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "nicky": "nicholas", "pam": "pamela", "pat": "patrick patricia",
    "patty": "patricia", "peggy": "margaret", "penny": "penelope", "pete": "peter", "phil": "philip", "polly": "mary", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sally": "sarah",
    "sam": "samuel samantha", "sandy": "alexander sandra", "steve": "stephen steven", "sue": "susannah susan", "susie": "susannah susan", "suzy": "susannah susan", "ted": "edward theodore", "teddy": "edward theodore", "terry": "terence theresa",
    "theo": "theodore", "tim": "timothy", "toby": "tobias", "tom": "thomas", "tony": "anthony", "vic": "victor victoria", "vicky": "victoria", "tori": "victoria", "will": "william", "willy": "william", "zack": "zachary",
}
#: Length from which an edit is taken for a typo; one of the two tokens may be a letter shorter.
TYPO_LENGTH = 5
#: Length of both tokens from which two edits are.
TWO_TYPOS_LENGTH = 12
#: Cost of aligning two tokens.
NICKNAME, TYPO, TWO_TYPOS, ABBREVIATION, INITIAL, SPARE_INITIAL = 0.2, 0.3, 0.35, 0.4, 0.6, 0.5
_NEVER = 99.0


def plain(name: str) -> str:
    """Lower case without accents; undoes UTF-8 read as Latin-1, underscores and odd spaces."""
    if re.search("[ÃÂâ]", name):
        for codec in ("cp1252", "latin-1"):
            try:
                name = name.encode(codec).decode("utf-8")
                break
            except UnicodeError:
                pass
    flat = unicodedata.normalize("NFKD", name.casefold())
    flat = "".join(c for c in flat if not unicodedata.combining(c)).replace("_", " ")
    return re.sub(r"\s+", " ", flat).strip()


def tokens(name: str, kind: str) -> list[str] | None:
    """The tokens that tell the name apart, in order; None if it names nobody, many or two performers."""
    s = plain(name)
    if re.sub(r"[\W_]+", " ", s).strip() in PLACEHOLDERS:
        return None
    if kind == "artist" and JOINED.search(s):
        return None
    s = re.sub(r"\(\s*([^()]*?)\s*\)", lambda m: " " if m[1] in QUALIFIERS else f" {m[1]} " if m[1] not in NUMBERS else f" vol {m[1]} ", s)
    if kind == "artist":
        s = re.sub(r'["“”„][^"“”„]*["“”„]', " ", s)
    s = re.sub(r"\b(?:[^\W\d_]\.\s?){2,}", lambda m: " " + " ".join(re.findall(r"\w", m[0])) + " ", s)
    s = s.replace("'", "").replace("’", "")
    words, out, i = re.findall(r"\w+", s), [], 0
    while i < len(words):
        w, then = words[i], words[i + 1] if i + 1 < len(words) else ""
        number = NUMBERS.get(then, int(then) if then.isdecimal() else None)
        if kind == "album" and w in VOLUMES and number is not None:
            out.append(f"#{number}")
            i += 2
            continue
        if w == "ost" or words[i : i + 3] == ["o", "s", "t"]:
            out += ["original", "soundtrack"]
            i += 1 if w == "ost" else 3
            continue
        if kind == "artist" and w in SIZES:
            w = SIZES[w]
        if w not in CONNECTORS or len(w) == 1:
            out.append(w)
        i += 1
    out = out or words
    return out or None


@lru_cache(maxsize=1 << 16)
def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours makes ``b`` of ``a``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    short, long = sorted((a, b), key=len)
    return short[i:] == long[i + 1 :]


@lru_cache(maxsize=1 << 16)
def two_edits(a: str, b: str) -> bool:
    """Whether at most two insertions, deletions or substitutions make ``b`` of ``a``."""
    if abs(len(a) - len(b)) > 2:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        if min(row) > 2:
            return False
    return row[-1] <= 2


@lru_cache(maxsize=1 << 16)
def token_cost(a: str, b: str, people: bool) -> float:
    """What it costs to take ``a`` and ``b`` for the same word; numbers are never alike."""
    if a == b:
        return 0.0
    if a[0] == "#" or b[0] == "#" or a.isdecimal() or b.isdecimal():
        return _NEVER
    if people:
        x, y = NICKNAMES.get(a, "").split(), NICKNAMES.get(b, "").split()
        if b in x or a in y or set(x) & set(y):
            return NICKNAME
        if any(n[0] == b for n in x) or any(n[0] == a for n in y):
            return INITIAL
    if min(len(a), len(b)) >= TYPO_LENGTH - 1 and max(len(a), len(b)) >= TYPO_LENGTH and one_edit(a, b):
        return TYPO
    if min(len(a), len(b)) >= TWO_TYPOS_LENGTH and two_edits(a, b):
        return TWO_TYPOS
    short, long = sorted((a, b), key=len)
    if short[0] != long[0]:
        return _NEVER
    if len(short) == 1:
        return INITIAL
    if len(short) <= 4 and len(long) > len(short):
        if long.startswith(short):
            return ABBREVIATION
        rest = iter(long)
        if all(c in rest for c in short) and not set(short[1:]) & set("aeiou"):
            return ABBREVIATION
    return _NEVER


def assign(cost: list[list[float]]) -> tuple[float, list[int]]:
    """Least total cost of a square matrix and the column of each row: shortest augmenting paths."""
    n = len(cost)
    u, v, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, came, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while row_of[j0]:
            done[j0] = True
            i0, delta, j1 = row_of[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not done[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], came[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            row_of[j0] = row_of[came[j0]]
            j0 = came[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return sum(cost[i][out[i]] for i in range(n)), out


def align(a: list[str], b: list[str], people: bool) -> tuple[float, list[str]] | None:
    """Cost of the best alignment of two token lists, and what the initials of ``a`` stand for in ``b``.

    Every token needs a partner, but for initials: those of one side may be left over, as people leave
    out middle initials. A pair needs one token in common that is no abbreviation. None if
    there is no such alignment. A short token may also be read as the initials of several words.
    """
    best = None
    readings = [a] + [a[:i] + list(t) + a[i + 1 :] for i, t in enumerate(a) if 2 <= len(t) <= 3 and t.isalpha() and len(a) < len(b)]
    for x in readings:
        n = max(len(x), len(b))
        spare = lambda t: SPARE_INITIAL if len(t) == 1 and people else _NEVER
        cost = [[token_cost(x[i], b[j], people) if i < len(x) and j < len(b) else spare(x[i]) if i < len(x) else spare(b[j]) for j in range(n)] for i in range(n)]
        total, to = assign(cost)
        if total >= _NEVER:
            continue
        pairs = [(x[i], b[to[i]]) for i in range(len(x)) if to[i] < len(b)]
        shared = [i for i, (p, q) in enumerate(pairs) if min(len(p), len(q)) >= 3 and token_cost(p, q, people) <= TYPO and (p not in NICKNAMES or not people)]
        if not shared:
            continue
        # With an initial left over, another word must agree: "M. Smith" isn't "W. M. Smith".
        if (len(pairs) < n) and not any(i != shared[0] and max(len(p), len(q)) > 1 for i, (p, q) in enumerate(pairs)):
            continue
        means = sorted(q for p, q in pairs if len(p) == 1 and len(q) > 1) + sorted(q for p, q in pairs if people and p in NICKNAMES and p != q and len(q) > 1)
        if best is None or total < best[0]:
            best = total, means
    return best


def agree(readings: list[list[str]], people: bool) -> bool:
    """Whether all ``readings`` of an abbreviated name can be spellings of the longest one's words."""
    fullest = max(readings, key=lambda r: (len(r), sum(map(len, r)), r))
    letters = {f[0] for f in fullest}
    known = lambda w: any(token_cost(w, f, people) <= ABBREVIATION for f in fullest) or (len(w) <= 3 and len(fullest) > 1 and set(w) <= letters)
    return all(known(w) for r in readings for w in r)


def _deletions(t: Column) -> Column:
    """The token and what is left of it without a letter, from ``TWO_TYPOS_LENGTH`` letters also without two."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = without(t)
    return F.array_distinct(F.concat(F.array(t), one, F.when(F.length(t) >= TWO_TYPOS_LENGTH, F.flatten(F.transform(one, without))).otherwise(F.array().cast("array<string>"))))


def _close(x: Column, y: Column) -> Column:
    """Whether the tokens are one edit apart (a swap of neighbours is one), or long and two."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x))) == y)
    one = (F.greatest(F.length(x), F.length(y)) >= TYPO_LENGTH) & ((F.levenshtein(x, y, 1) >= 0) | ((F.length(x) == F.length(y)) & swapped))
    return one | ((F.least(F.length(x), F.length(y)) >= TWO_TYPOS_LENGTH) & (F.levenshtein(x, y, 2) >= 0))


def _near_tokens(words: DataFrame) -> DataFrame:
    """``(kind, rare, often)``: tokens one edit apart, long ones two, by an index of their deletions.

    Tokens that near share a deletion, so an equi-join on deletions finds all of them.
    ``often`` is the token in more names, at equal number the smaller one.
    """
    index = words.filter((F.length("t") >= TYPO_LENGTH - 1) & ~F.col("t").startswith("#")).select("kind", "t", "names", F.explode(_deletions(F.col("t"))).alias("d"))
    a, b = [index.select(F.col("kind").alias(f"{s}k"), F.col("t").alias(f"{s}t"), F.col("names").alias(f"{s}n"), F.col("d").alias(f"{s}d")) for s in "ab"]
    near = a.join(b, (F.col("ak") == F.col("bk")) & (F.col("ad") == F.col("bd")) & ((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("at") > F.col("bt")))))
    return near.select(F.col("ak").alias("kind"), F.col("at").alias("rare"), F.col("bt").alias("often")).distinct().filter(_close(F.col("rare"), F.col("often")))


def same_names(names: DataFrame) -> DataFrame:
    """``(kind, a, b)``, a < b: spellings of one entity among ``names (kind, name)``; kind ``artist`` or ``album``.

    1. Names are cut to tokens; placeholders and credits of two performers are left out. Names with
       the same tokens in any order are one class.
    2. Tokens one edit apart are found by a symmetric-delete index.
    3. A class looks for others under its rarest token (without one of four letters, under each of
       three) and under what its tokens may be typos of, each with the initial of another token; the
       others are listed under each token of three letters that is no nickname, with each initial. So a common given name or ensemble word brings no candidates by itself.
    4. Candidates are aligned token by token at least cost (optimal assignment), permitting typos,
       nicknames, abbreviations and initials. An initial or nickname that could stand for different
       words in equally good partners is ambiguous, and that class links to nobody.
    5. Links are consolidated to entities, and an entity's spellings are paired.

    Null and blank names are ignored; repeated names count once. Names are compared as stored, so
    two that differ only in case or accents are a pair.
    """
    distinct = names.filter("kind IS NOT NULL AND name IS NOT NULL").select("kind", "name").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(tokens=[tokens(n, k) for k, n in zip(b["kind"], b["name"])])
            yield b[b["tokens"].notna()]

    spelled = distinct.mapInPandas(read, "kind string, name string, tokens array<string>")
    spelled = cut(spelled.select("kind", "name", F.array_sort("tokens").alias("tokens")).withColumn("id", node_id("c", F.concat_ws("\t", "kind", F.array_join("tokens", " ")))))
    classes = spelled.groupBy("id").agg(F.first("kind").alias("kind"), F.first("tokens").alias("tokens"))
    links = cut(aligned_pairs(classes))

    def doubtful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[not agree([list(r) for r in readings], kind == "artist") for kind, readings in zip(b["kind"], b["readings"])]][["id"]]

    judged = links.withColumn("m", F.when(F.size("means") > 0, F.array_sort("means"))).select("kind", "id", "oid", "m")
    readings = judged.filter("m IS NOT NULL").groupBy("id").agg(F.first("kind").alias("kind"), F.collect_set("m").alias("readings"))
    doubt = cut(readings.filter(F.size("readings") > 1).mapInPandas(doubtful, "id binary").select(F.col("id").alias("did")))
    sure = judged.join(doubt, F.col("id") == F.col("did"), "left").filter(F.col("did").isNull() | F.col("m").isNull())
    sure = sure.join(doubt.select(F.col("did").alias("xid")), F.col("oid") == F.col("xid"), "left").filter("xid IS NULL OR did IS NOT NULL")
    groups = connected_groups(sure.select("id", "oid").unionByName(classes.select("id", F.col("id").alias("oid"))), "id", "oid")
    named = cut(spelled.join(groups, F.col("id") == F.col("node")).select("kind", "name", "group"))
    other = named.select(F.col("name").alias("b"), F.col("group").alias("bg"))
    return named.join(other, (F.col("group") == F.col("bg")) & (F.col("name") < F.col("b"))).select("kind", F.col("name").alias("a"), "b")


def aligned_pairs(classes: DataFrame) -> DataFrame:
    """``(kind, id, oid, cost, means)``: pairs of ``classes (id, kind, tokens)`` that align, found by steps 2 to 4 of ``same_names``."""
    words = classes.select("id", "kind", F.explode(F.array_distinct("tokens")).alias("t"))
    counted = words.groupBy("kind", "t").agg(F.count("*").alias("names"))
    near = cut(_near_tokens(counted))

    known = words.join(counted.select(F.col("kind").alias("ck"), F.col("t").alias("ct"), "names"), (F.col("kind") == F.col("ck")) & (F.col("t") == F.col("ct"))).select("id", "kind", "t", "names")
    long = (F.length("t") >= 4) & ~((F.col("kind") == "artist") & F.col("t").isin(*NICKNAMES))
    rarest = known.groupBy("id").agg(F.min(F.struct((~long).alias("short"), "names", "t")).alias("m")).select("id", F.col("m.t").alias("t"))
    # A pair needs a token of three letters in common that is no nickname: names without a long one look under all of those.
    common = (F.length("t") >= 3) & ~((F.col("kind") == "artist") & F.col("t").isin(*NICKNAMES))
    brief = known.groupBy("id").agg(F.max(long).alias("any")).filter("NOT any").select(F.col("id").alias("bid"))
    under = known.filter(common).join(brief, F.col("id") == F.col("bid")).select("id", F.col("t").alias("own"), "t")
    meant = known.join(near, (known["kind"] == near["kind"]) & (F.col("t") == F.col("rare"))).select("id", F.col("t").alias("own"), F.col("often").alias("t"))
    anchors = rarest.select("id", F.col("t").alias("own"), "t").unionByName(under).unionByName(meant)

    def initials(own: Column) -> Column:
        """First letters of a class's other tokens (also of what nicknames stand for); '' if it has none."""
        others = F.array_distinct(F.transform(F.filter("tokens", lambda x: x != own), lambda x: F.substring(x, 1, 1)))
        return F.when(F.size("tokens") < 2, F.array(F.lit(""))).otherwise(others)

    plain_classes = classes.select(F.col("id").alias("cid"), F.col("kind").alias("ckind"), "tokens")
    formal = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(sorted({x[0] for x in full.split()})).alias("i")) for n, full in NICKNAMES.items()])
    seek = anchors.join(plain_classes, F.col("id") == F.col("cid")).withColumn("i", initials(F.col("own")))
    nicked = F.flatten(F.transform(F.filter(formal, lambda f: F.array_contains("tokens", f["n"])), lambda f: f["i"]))
    seek = seek.select("id", F.col("ckind").alias("kind"), "t", F.explode(F.array_union("i", nicked)).alias("i")).distinct()
    listed = words.filter(common).select(F.col("id").alias("oid"), F.col("kind").alias("okind"), F.col("t").alias("ot")).join(plain_classes, F.col("oid") == F.col("cid"))
    listed = listed.select("oid", "okind", "ot", F.explode(initials(F.col("ot"))).alias("oi")).distinct()
    pairs = seek.join(listed, (F.col("kind") == F.col("okind")) & (F.col("t") == F.col("ot")) & (F.col("i") == F.col("oi")) & (F.col("id") != F.col("oid"))).select("kind", "id", "oid").distinct()
    pairs = pairs.join(plain_classes.select("cid", F.col("tokens").alias("a")), F.col("id") == F.col("cid")).drop("cid").join(plain_classes.select("cid", F.col("tokens").alias("b")), F.col("oid") == F.col("cid")).drop("cid")

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, i, j, a, b in batch[["kind", "id", "oid", "a", "b"]].itertuples(index=False):
                found = align(list(a), list(b), kind == "artist")
                if found:
                    rows.append((kind, i, j, found[0], found[1]))
            yield pd.DataFrame(rows, columns=["kind", "id", "oid", "cost", "means"])

    return pairs.mapInPandas(aligned, "kind string, id binary, oid binary, cost double, means array<string>")


def same_performers_and_albums(df: DataFrame) -> DataFrame:
    """``(name_kind, name_a, name_b)`` over id3_artist and id3_albumartist together, and id3_album."""
    artist = F.struct(F.lit("artist").alias("kind"), F.col("id3_artist").alias("name"))
    second = F.struct(F.lit("artist").alias("kind"), F.col("id3_albumartist").alias("name"))
    album = F.struct(F.lit("album").alias("kind"), F.col("id3_album").alias("name"))
    names = df.select(F.explode(F.array(artist, second, album)).alias("n")).select("n.kind", "n.name")
    return same_names(names).select(F.col("kind").alias("name_kind"), F.col("a").alias("name_a"), F.col("b").alias("name_b"))
