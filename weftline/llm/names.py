"""Link the spellings of names typed by people that mean the same person (problem 5).

Method: spellings are read into tokens; profiles are blocked by phonetic codes of their sorted tokens, compared by
Jaro-Winkler with a table of nicknames, and accepted pairs are clustered by connected components. No list of names says
which token is a given name: tokens are compared as sets, whatever their order, and what a corpus itself shows of a word
(how often it is written, whether it stands between others) is counted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from weftline.llm.blocks import join_in_blocks
from weftline.llm.components import connected_components
from weftline.operators.lookup import lookup_join
from weftline.session import cut

# Forms of address and marks that are no part of a name.
TITLES = set("int interprete lic licda mtro mtra maestro maestra prof profa profr profra dr dra ing arq sr sra srta don dona lsm".split())
PARTICLES = set("de del la las los".split())
# Nicknames in Mexican Spanish and English, and the given name each stands for.
NICKNAMES = dict(
    pair.split(":")
    for pair in """ale:alejandra alex:alejandro angie:angeles geles:angeles anita:ana bety:beatriz betty:beatriz bea:beatriz beto:roberto berna:bernardo beny:bernardo
    caro:carolina ceci:cecilia chabela:isabel chava:salvador chavo:salvador chayo:rosario charo:rosario chela:graciela chelo:consuelo chepe:jose chucho:jesus chuy:jesus
    concha:concepcion conchita:concepcion cuca:refugio cuco:refugio cuquita:refugio dani:daniel emi:emilia mily:emilia fer:fernanda fercho:fernando nando:fernando
    gabo:gabriel gabi:gabriela gaby:gabriela lencho:lorenzo lore:lorena guille:guillermo memo:guillermo hec:hector tito:hector isa:isabel chabe:isabel isabelita:isabel
    kari:karina kary:karina lalo:eduardo edu:eduardo lety:leticia leti:leticia licha:alicia lichita:alicia lola:dolores lolita:dolores lupe:guadalupe lupita:guadalupe
    pita:guadalupe luisito:luis guicho:luis manolo:manuel manu:manuel meche:mercedes merce:mercedes nacho:ignacio nico:nicolas neto:ernesto paco:francisco pancho:francisco
    kiko:francisco pato:patricia paty:patricia pati:patricia pepe:jose pepito:jose pili:pilar pilarica:pilar poncho:alfonso quique:enrique kike:enrique rafa:rafael
    raulito:raul ricky:ricardo rodri:rodrigo rodo:rodrigo rober:roberto sil:silvia silvi:silvia sofi:sofia tavo:octavio tere:teresa teresita:teresa tencha:hortensia
    horte:hortensia tomasito:tomas tommy:tomas tono:antonio tonito:antonio toni:antonio uli:ulises vale:valeria vero:veronica wen:wendolin wendy:wendolin xime:ximena
    yola:yolanda yoli:yolanda zori:zoraida zory:zoraida
    andy:andrew beth:elizabeth bill:william bob:robert dick:richard jack:john jim:james kate:katherine mike:michael peggy:margaret ted:edward tom:thomas""".split()
)
#: Words are alike from LIKE on; all words of a pair from MEAN on, with SLIPS slips at most. A single slip counts as SLIP at least, as Jaro-Winkler rates a letter left out near the start low.
LIKE, MEAN, SLIP, SLIPS = 0.84, 0.90, 0.92, 2
#: Two words that each stand in so many profiles, and the rarer in this share of the other's, are two names and not slips of one.
OFTEN, SHARE = 5, 0.1
#: A word that follows first words of so many initials, and is last or before a comma in so small a share of its profiles, is a second given name.
INITIALS, ENDS = 3, 0.15
#: What a short form costs whose parts don't follow each other in the full name; both must be words without a slip.
APART = 0.05


@lru_cache(maxsize=1 << 18)
def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two strings from 0 to 1, with Winkler's bonus of 0.1 a letter for up to four equal first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, u in zip(b, used) if u]
    m, swapped = len(mine), sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@lru_cache(maxsize=1 << 18)
def slips(a: str, b: str) -> int:
    """How many letters were added, left out, changed or swapped with the next; 3 for more than two."""
    if abs(len(a) - len(b)) > 2:
        return 3
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return min(one[-1], 3)


#: Longest words that are compared in a batch; longer ones are compared one by one.
BATCHED = 32


def jaro_winkler_many(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """jaro_winkler of many pairs at once."""
    if any(len(x) > BATCHED for x in (*a, *b)):
        return np.array([jaro_winkler(x, y) for x, y in zip(a, b)])
    x, y, n, m = _letters(a, b)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    mine, theirs = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i in range(int(n.max(initial=0))):
        for j in range(max(0, i - int(reach.max())), min(int(m.max()), i + int(reach.max()) + 1)):
            hit = (x[:, i] == y[:, j]) & (x[:, i] > 0) & ~mine[:, i] & ~theirs[:, j] & (abs(i - j) <= reach)
            mine[:, i] |= hit
            theirs[:, j] |= hit
    k = mine.sum(1)
    in_order = lambda c, used: np.take_along_axis(c, np.argsort(~used, axis=1, kind="stable"), 1)
    swapped = ((in_order(x, mine) != in_order(y, theirs)) & (np.arange(BATCHED) < k[:, None])).sum(1) / 2
    some = np.maximum(k, 1)
    jaro = np.where(k > 0, (k / np.maximum(n, 1) + k / np.maximum(m, 1) + (k - swapped) / some) / 3, 0.0)
    same = np.cumprod((x[:, :4] == y[:, :4]) & (x[:, :4] > 0), axis=1).sum(1)
    return np.where((n == m) & (x == y).all(1), 1.0, jaro + same * 0.1 * (1 - jaro))


def slips_many(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """slips of many pairs at once."""
    if any(len(x) > BATCHED for x in (*a, *b)):
        return np.array([slips(x, y) for x, y in zip(a, b)])
    x, y, n, m = _letters(a, b)
    d = np.zeros((int(n.max(initial=0)) + 1, int(m.max(initial=0)) + 1, len(n)), np.int16)
    d[:, 0], d[0, :] = np.arange(d.shape[0])[:, None], np.arange(d.shape[1])[:, None]
    for i in range(1, d.shape[0]):
        for j in range(1, d.shape[1]):
            best = np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]) + 1, d[i - 1, j - 1] + (x[:, i - 1] != y[:, j - 1]))
            if i > 1 and j > 1:
                turned = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(turned, np.minimum(best, d[i - 2, j - 2] + 1), best)
            d[i, j] = best
    return np.minimum(d[n, m, np.arange(len(n))], 3)


def _letters(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code = lambda s: np.array(s, f"U{BATCHED}").reshape(-1, 1).view(np.uint32).reshape(len(s), BATCHED)
    return code(list(a)), code(list(b)), np.array([len(x) for x in a]), np.array([len(x) for x in b])


def phonetic(token: str) -> str:
    """A code of how a Spanish name sounds: its consonants, those that sound alike as one, doubles as one."""
    t = re.sub(r"h", "", re.sub(r"ch", "X", token))
    for a, b in ((r"qu|k|c(?=[aoulrt]|$)", "K"), (r"c(?=[eiy])|[zs]", "S"), (r"c", "K"), (r"g(?=[ei])|j", "J"), (r"gu(?=[ei])|g", "G"), (r"[bvw]", "B"), (r"ll|y", "Y"), (r"[nm]", "N")):
        t = re.sub(a, b, t)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[aeiou]", "", t)).upper() or token[:1].upper()


def full_name(token: str) -> str:
    """The name that a nickname, or a diminutive of one, stands for; any other token itself."""
    if token in NICKNAMES:
        return NICKNAMES[token]
    short = re.sub(r"(?:it|cit)(?=[oa]$)", "", token)
    return NICKNAMES.get(short, token) if len(short) > 2 else token


def read_name(spelling: str) -> tuple[list[str], int]:
    """The tokens of a spelling, in plain letters: words and initials; and how many of the last are surnames as they stood before a comma. What stands behind a comma comes first; a lone word is read as an initial and a word written together, unless it is a nickname; a spelling without letters is one token."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", spelling).casefold() if not unicodedata.combining(c))
    flat = re.sub(r"\(.*?\)", " ", flat)
    parts = [[t for t in re.findall(r"[^\W\d_]+", p) if t not in TITLES and t not in PARTICLES] for p in flat.split(",")]
    tokens = [t for p in (*parts[1:], parts[0]) for t in p]
    tokens = [t for i, t in enumerate(tokens) if t != "y" or i in (0, len(tokens) - 1)]
    if not tokens:
        return ["".join(re.findall(r"\w", flat)) or flat.strip()], 0
    if len(tokens) == 1 and len(tokens[0]) > 3 and tokens[0] not in NICKNAMES:
        return [tokens[0][0], tokens[0][1:]], 0
    return [full_name(t) for t in tokens], len(parts[0]) if any(parts[1:]) else 0


def block_keys(tokens: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """Keys under which a profile meets others: the phonetic codes of its sorted words, and of each two of them. Then the keys by which it looks for others, and those by which it is found: an initial that stands for a token with a code, and two codes, where the code may have a letter left out."""
    codes = {i: phonetic(t) for i, t in enumerate(tokens) if len(t) > 1}
    keys = {"+".join(sorted(codes.values()))} | {"+".join(sorted((codes[i], codes[j]))) for i in codes for j in codes if i < j}
    slipped = {i: {c} | {c[:k] + c[k + 1 :] for k in range(len(c)) if len(c) > 2} for i, c in codes.items()}
    found = {f"{v[0]}|{c}" for i in codes for j, v in enumerate(tokens) if i != j for c in slipped[i]} | {f"{codes[j]}+{c}" for i in codes for j in codes if i != j for c in slipped[i]}
    looks = {f"{v}|{c}" for i in codes for v in tokens if len(v) == 1 for c in slipped[i]} | {f"{codes[j]}+{c}" for i in codes for j in codes if i != j for c in slipped[i]}
    return sorted(keys - looks), sorted(looks), sorted(found)


def read_names(spellings: DataFrame, column: str) -> DataFrame:
    """spelling, profile (its tokens in one text), tokens, surnames, keys, looks, found of each distinct non-blank spelling."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for s in pdf["spelling"]:
                tokens, surnames = read_name(s)
                out.append((s, " ".join(tokens), tokens, surnames, *block_keys(tokens)))
            yield pd.DataFrame(out, columns=["spelling", "profile", "tokens", "surnames", "keys", "looks", "found"])

    own = spellings.select(F.col(column).alias("spelling")).filter(r"spelling is not null and not spelling rlike '\\A\\s*\\z'").distinct()
    return own.mapInPandas(rows, "spelling string, profile string, tokens array<string>, surnames int, keys array<string>, looks array<string>, found array<string>")


def with_usage(profiles: DataFrame) -> DataFrame:
    """Add, for each token of a profile, in how many profiles it stands (n) and whether it is used as a second given name (mid); and the profile's tier, second given names aside: 3 for three words or more, 2 for two words and an initial, 1 for two words, 0 for less."""
    each = profiles.select("profile", F.posexplode("tokens").alias("at", "token"), F.size("tokens").alias("size"), F.greatest(F.lit(1), "surnames").alias("last"), F.left(F.col("tokens")[0], F.lit(1)).alias("initial"))
    used = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("at") >= F.col("size") - F.col("last")) & (F.col("at") > 0)).alias("ends"),
        F.size(F.collect_set(F.when((F.col("at") == 1) & (F.col("size") > 2), F.col("initial")))).alias("initials"),
    )
    used = used.select("token", F.col("n").cast("int").alias("n"), ((F.col("initials") >= INITIALS) & (F.col("ends") <= ENDS * F.col("n"))).alias("mid"))
    back = lookup_join(each.select("profile", "at", "token"), used, ["token"]).groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("at", "n", "mid"))).alias("u"))
    told = profiles.join(back, "profile").select(*profiles.columns, F.col("u.n").alias("n"), F.col("u.mid").alias("mid"))
    main = F.filter("tokens", lambda t, i: (i == 0) | ~F.get("mid", i))
    words = F.size(F.filter(main, lambda t: F.length(t) > 1))
    return told.withColumn("tier", F.when(words > 2, 3).when(words < 2, 0).when(F.size(main) > 2, 2).otherwise(1))


def agree(a: Sequence[str], b: Sequence[str], na: Sequence[int], nb: Sequence[int], mid_a: Sequence[bool], mid_b: Sequence[bool], like: dict[tuple[str, str], tuple[float, int]]) -> float:
    """How well two profiles agree, 0 if they contradict each other: the mean similarity of the words both have.

    Words are paired by similarity whatever their order, then initials with the words left. Only one side may have words
    or initials over, apart from second given names. `like` has the similarity and the slips of two words.
    """
    words_a, words_b = [i for i, t in enumerate(a) if len(t) > 1], [j for j, t in enumerate(b) if len(t) > 1]

    def value(i: int, j: int) -> tuple[float, int]:
        if a[i] == b[j]:
            return 1.0, 0
        least, most = sorted((na[i], nb[j]))
        return (0.0, 3) if least >= OFTEN and least >= SHARE * most else like[a[i], b[j]]

    found = sorted(((*value(i, j), i, j) for i in words_a for j in words_b), key=lambda f: (-f[0], abs(f[2] - f[3]), f[2], f[3]))
    at, scores, n_slips = {}, [], 0
    for s, k, i, j in found:
        if s >= LIKE and k <= SLIPS and i not in at and j not in at.values():
            at[i] = j
            scores.append(s)
            n_slips += k
    over_a, over_b = [i for i, t in enumerate(a) if i not in at], [j for j, t in enumerate(b) if j not in at.values()]
    n_words = len(at)
    for i in list(over_a):
        # An initial goes with a word of the same letter, or with the same initial.
        mates = [j for j in over_b if a[i][0] == b[j][0] and (len(a[i]) == 1 or len(b[j]) == 1)]
        if mates:
            at[i] = mates[0]
            over_a.remove(i)
            over_b.remove(mates[0])
    if n_words == 0 or len(at) < 2 or n_slips > SLIPS or sum(scores) / n_words < MEAN:
        return 0.0
    # A second given name, or an initial between others, may be over on both sides.
    if over_a and over_b:
        over_a = [i for i in over_a if not (i > 0 and mid_a[i] or len(a[i]) == 1 and 0 < i < len(a) - 1)]
        over_b = [j for j in over_b if not (j > 0 and mid_b[j] or len(b[j]) == 1 and 0 < j < len(b) - 1)]
        if over_a and over_b:
            return 0.0
    apart = _apart(a, b, at, mid_a, mid_b)
    return 0.0 if apart and (n_slips or n_words < 2) else sum(scores) / n_words - APART * apart


def _apart(a: Sequence[str], b: Sequence[str], at: dict[int, int], mid_a: Sequence[bool], mid_b: Sequence[bool]) -> bool:
    """Whether the two parts of a short form don't follow each other in the longer name, second given names aside, going round at its end."""
    main = lambda t, mid: [i for i in range(len(t)) if i == 0 or not mid[i]]
    own, other = main(a, mid_a), main(b, mid_b)
    if len(own) > len(other):
        own, other, at = other, own, {j: i for i, j in at.items()}
    if len(own) != 2 or len(other) < 3 or any(at.get(i) not in other for i in own):
        return False
    p, q = other.index(at[own[0]]), other.index(at[own[1]])
    return (q - p) % len(other) != 1


def _agreement(ta: pd.Series, tb: pd.Series, na: pd.Series, nb: pd.Series, ma: pd.Series, mb: pd.Series) -> pd.Series:
    """agree for a batch of pairs: all their different words are compared at once."""
    pairs = list({(x, y) for p, q in zip(ta, tb) for x in p for y in q if len(x) > 1 and len(y) > 1 and x != y and abs(len(x) - len(y)) <= SLIPS})
    like: dict[tuple[str, str], tuple[float, int]] = _Unlike()
    if pairs:
        jw = jaro_winkler_many(*zip(*pairs))
        near = np.flatnonzero(jw >= 0.6)
        if len(near):
            k = slips_many([pairs[i][0] for i in near], [pairs[i][1] for i in near])
            like.update((pairs[i], (max(float(jw[i]), SLIP if n == 1 else 0.0), int(n))) for i, n in zip(near, k))
    return pd.Series([agree(*x, like) for x in zip(ta, tb, na, nb, ma, mb)], dtype="float64")


class _Unlike(dict):
    def __missing__(self, key: tuple[str, str]) -> tuple[float, int]:
        return 0.0, 3


def link_spellings(spellings: DataFrame, column: str) -> DataFrame:
    """spelling, person: the distinct non-blank spellings of a column; those that mean one person have one `person`.

    Spellings that read alike form one profile; only profiles are compared. Fuller profiles are clustered first; a
    shorter one joins the cluster it agrees with best, if no other agrees as well. One that fits two people equally well
    joins neither, so that it doesn't link them, but the typings of it are linked with each other. Null and blank values
    have no row; an empty table gives none.
    """
    names = cut(read_names(spellings, column))
    profiles = cut(with_usage(names.groupBy("profile", "tokens", "keys", "looks", "found").agg(F.max("surnames").alias("surnames"))))
    told = ["profile", "tokens", "n", "mid", "tier"]
    side = lambda df, s: df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in told])
    keyed, looks, found = (profiles.withColumn("key", F.explode(c)) for c in ("keys", "looks", "found"))
    met = join_in_blocks(side(keyed, "a"), side(keyed, "b"), ["key"], "profile_a").filter("profile_a < profile_b")
    short = join_in_blocks(side(looks, "a"), side(found, "b"), ["key"], "profile_a").filter("profile_a <> profile_b")
    lesser = F.col("profile_a") < F.col("profile_b")
    short = short.select(*[F.when(lesser, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in told])
    pairs = met.drop("key").unionByName(short).dropDuplicates(["profile_a", "profile_b"])
    score = F.pandas_udf(_agreement, DoubleType())("tokens_a", "tokens_b", "n_a", "n_b", "mid_a", "mid_b")
    scored = pairs.withColumn("score", score).filter("score > 0")
    both = scored.select(F.col("profile_a").alias("a"), F.col("profile_b").alias("b"), F.col("tier_a").alias("ta"), F.col("tier_b").alias("tb"), "score")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("tb").alias("ta"), F.col("ta").alias("tb"), "score")))
    tiers = profiles.select("profile", "tier")
    placed: DataFrame | None = None
    for tier in (3, 2, 1, 0):
        here = tiers.filter(F.col("tier") == tier).select("profile")
        edges = both.filter((F.col("ta") == tier) & (F.col("tb") == tier)).select("a", "b")
        if placed is not None:
            fits = both.filter((F.col("ta") == tier) & (F.col("tb") > tier)).join(placed.withColumnRenamed("profile", "b"), "b").groupBy("a", "person").agg(F.round(F.max("score"), 6).alias("score"))
            best = fits.groupBy("a").agg(F.max(F.struct("score", "person")).alias("m"), F.min(F.struct(-F.col("score"), "person")).alias("l"))
            joined = cut(best.filter("m.person = l.person").select(F.col("a").alias("profile"), F.col("m.person").alias("person")))
            here = here.join(joined.select("profile"), "profile", "left_anti")
            edges = edges.join(joined.select(F.col("profile").alias("a")), "a", "left_anti").join(joined.select(F.col("profile").alias("b")), "b", "left_anti")
        groups = connected_components(edges).select(F.col("node").alias("profile"), F.col("component").alias("person"))
        alone = here.join(groups, "profile", "left").select("profile", F.coalesce("person", "profile").alias("person"))
        parts = [alone] if placed is None else [placed, joined, alone]
        placed = cut(reduce(lambda x, y: x.unionByName(y), parts))
    return lookup_join(names.select("spelling", "profile"), placed, ["profile"], written=True).select("spelling", "person")


def linked_pairs(linked: DataFrame) -> DataFrame:
    """Every pair of different spellings of a person, the lesser first."""
    a, b = linked.select("person", F.col("spelling").alias("x")), linked.select("person", F.col("spelling").alias("y"))
    return a.join(b, "person").filter("x < y").select("x", "y")
