"""Names as people type them, taken apart: the coined part, the describing words, given name, initials.

The describing words ("Applied", "Photonics") are learned from the names themselves: words that many rows share. Shortened,
clipped and mistyped forms are read as the word they stand for; initials stay initials and fit any word that begins so.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

# Legal forms, titles and remarks that are no part of a name.
LEGAL = frozenset("llc inc incorporated corp corporation co company ltd limited lp llp plc gmbh sa".split())
TITLES = frozenset("mr ms mrs dr prof col lt gen capt ret phd md jr sr ii iii iv esq".split())
REMARKS = re.compile(r"\(us\)|\[[^\]]*\]|,? a delaware company|/ *attn.*$|\(ret\.?\)|\b(hq|intl|international|usa|of america|group|holdings)\b|& co\b|^the\b")
DBA = re.compile(r"[(\s]*\b(d/b/a|dba|doing business as|formerly|fka|aka)\b.*$")
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіѕјԁһӏкмтвнАЕОРСУХІЅЈКМТВН", "aeopcyxisjdhlkmtbhaeopcyxisjkmtbh")
# Given names with the short forms in use.
GIVEN = {
    "abigail": "abby gail", "alexander": "alex sandy", "alexandra": "lexi alex sandra", "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb babs", "benjamin": "ben benny benji", "catherine": "cathy",
    "charles": "charlie chuck chas", "christina": "chris tina chrissy", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davey", "deborah": "debbie deb debra", "dorothy": "dottie dot dolly", "edward": "ed eddie ned ted",
    "eleanor": "ellie nell nora", "elizabeth": "liz beth betty lizzie eliza", "frances": "fran frankie fanny", "frederick": "fred freddie", "gabriela": "gaby gabi", "george": "georgie", "gregory": "greg gregg", "henry": "harry hank",
    "isabella": "bella izzy isa", "jacqueline": "jackie jacqui", "james": "jim jimmy jas jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey jos", "joshua": "josh", "katherine": "kate katie kathy kat kit",
    "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo", "margaret": "peggy maggie meg marge", "matthew": "matt matty", "matthias": "matt matty", "michael": "mike mick mickey", "nathaniel": "nate nat nathan", "nicholas": "nick nicky",
    "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "philippa": "pippa pip", "ramon": "moncho", "rebecca": "becca becky", "richard": "rick dick richie rich", "robert": "bob rob bobby bert", "ronald": "ron ronnie",
    "samuel": "sam sammy", "samantha": "sam", "stephen": "steve", "steven": "steve", "susan": "sue susie suzy", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori vic", "vincent": "vince vinny",
    "william": "bill will billy liam", "zachary": "zach zack zak", "zoe": "",
}


def plain(name: str) -> str:
    """Lower case without accents, look-alike letters and digits within words read as letters."""
    t = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", unicodedata.normalize("NFKC", name).translate(LOOKALIKES))
    t = unicodedata.normalize("NFKD", t)
    t = "".join(c for c in t if not unicodedata.combining(c)).lower().replace("ß", "ss").replace("r&d", "research")
    t = re.sub(r"(?<=[a-z])[013568](?=[a-z ]|$)|(?<![a-z0-9])[013568](?=[a-z]{2})", lambda m: {"0": "o", "1": "l", "3": "e", "5": "s", "6": "b", "8": "b"}[m.group()], t)
    return re.sub(r"\s+", " ", t).strip()


def sound(word: str) -> str:
    """Spellings of one sound in one form."""
    w = word.replace("rn", "m").replace("ph", "f").replace("ks", "x").replace("ck", "k").replace("y", "i").replace("c", "k").replace("z", "s").replace("l", "i")
    return re.sub(r"(.)\1+", r"\1", w)


def distance(a: str, b: str, most: int) -> int:
    """Edits between a and b, neighbouring letters that changed places being one; most+1 if there are more than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            cur.append(d)
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return min(prev[-1], most + 1)


def _clipped(short: str, word: str) -> bool:
    """short stands for word: its beginning, or its letters in order with most vowels left out."""
    if short[0] != word[0] or len(short) >= len(word):
        return False
    if word.startswith(short):
        return len(short) >= 3
    it = iter(word)
    return len(short) >= 3 and all(c in it for c in short) and sum(c in "aeiou" for c in short[1:]) <= 1


def _within(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


@dataclass
class Name:
    coined: str = ""
    words: list[str] = field(default_factory=list)  # describing words
    initials: str = ""
    given: tuple[str, ...] = ()  # what the given name may stand for; empty for organisations
    middle: str = ""

    @property
    def person(self) -> bool:
        return bool(self.given)


class Reader:
    """Takes names apart with the describing words of a corpus."""

    def __init__(self, vocabulary: Iterable[str]):
        self.words = sorted(set(vocabulary))
        self.known = set(self.words)
        self.by_letter: dict[str, list[str]] = {}
        for w in self.words:
            self.by_letter.setdefault(w[0], []).append(w)
        self.given: dict[str, set[str]] = {}
        for full, short in GIVEN.items():
            for s in (full, *short.split()):
                self.given.setdefault(s, set()).add(full)
        self.memo: dict[str, str | None] = {}

    def word(self, token: str) -> str | None:
        """The describing word that a token is, misspells or shortens."""
        if token in self.known:
            return token
        if token not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[token] = self._word(token)
        return self.memo[token]

    def _word(self, token: str) -> str | None:
        if len(token) >= 4:
            most = 1 if len(token) < 8 else 2
            close = [w for w in self.words if abs(len(w) - len(token)) <= most and (w[0] == token[0] or len(token) > 6 and w[-3:] == token[-3:])]
            near = [(d, not _within(token, w), w) for w in close if (d := distance(token, w, most)) <= most]
            if near and (len(token) > 4 or not min(near)[1]):
                return min(near)[2]
        if len(token) >= 3:
            clipped = [w for w in self.by_letter.get(token[0], ()) if _clipped(token, w)]
            if clipped:
                starts = [w for w in clipped if w.startswith(token)] or clipped
                return starts[0] if len(starts) == 1 else token + "*"  # "mari." may be marine or maritime
        fixed = {"sw": "software", "hw": "hardware", "mfg": "manufacturing", "eng": "engineering", "tech": "technologies", "univ": "university", "labs": "laboratories"}.get(token)
        return fixed if fixed in self.known else None

    def given_of(self, token: str) -> tuple[str, ...]:
        if token in self.given:
            return tuple(sorted(self.given[token]))
        if len(token) >= 4:
            near = {g for s, full in self.given.items() if len(s) >= 4 and s[0] == token[0] and distance(token, s, 1) <= 1 for g in full}
            if not near and len(token) >= 6:
                near = {g for s, full in self.given.items() if len(s) >= 6 and distance(token, s, 2) <= 2 for g in full}
            return tuple(sorted(near))
        return ()

    def read(self, name: str) -> list[Name]:
        """One or two readings: the second takes short tokens after the coined part as torn off it."""
        t = plain(name)
        t = REMARKS.sub(" ", DBA.sub("", t))
        t = re.sub(r"\bl\. ?l\. ?c\b\.?|\bl\. ?p\b\.?", " llc ", t)
        tokens = [x for x in re.sub(r"[^a-z0-9']+", " ", t).replace("'", "").split() if x not in ("the", "of")]
        legal = any(x in LEGAL for x in tokens)
        tokens = [x for x in tokens if x not in LEGAL and not x.isdigit()]
        if not legal and not any(x in self.known for x in tokens):
            person = self._person([x for x in tokens if x not in TITLES], True)
            if person:
                return [person]
        readings = [self._organisation(tokens, False)]
        if not legal and not any(x in self.known for x in tokens) and len(readings[0].words) < 2:
            person = self._person([x for x in tokens if x not in TITLES], False)
            if person and "?" not in person.given[0]:
                return [person]
            readings += [person] if person else []
        torn = self._organisation(tokens, True)
        if torn.coined != readings[0].coined:
            readings.append(torn)
        return [r for r in readings if r.coined]

    def _organisation(self, tokens: list[str], torn: bool) -> Name:
        out, parts, after = Name(), [], False
        longest = max((len(x) for x in tokens if not self.word(x)), default=0)
        for x in tokens:
            w = self.word(x)
            if torn and after and len(x) <= 4 and x not in self.known and len(x) > 1:
                parts.append(x)
                after = False
                continue
            after = False
            if w:
                out.words.append(w)
            elif len(x) == 1:
                out.initials += x
            elif x == "and":
                continue
            elif len(x) <= 4 and longest >= 6 and x != tokens[0] or (len(x) <= 3 and longest >= 5):
                out.initials += x
            else:
                glued = next((w for w in self.words if len(w) >= 5 and len(x) - len(w) >= 3 and (x.endswith(w) or x.startswith(w))), None)
                if glued:
                    out.words.append(glued)
                    x = x[: -len(glued)] if x.endswith(glued) else x[len(glued) :]
                parts.append(x)
                after = True
        out.coined = sound("".join(parts))
        out.words.sort()
        return out

    def _person(self, tokens: list[str], exact: bool) -> Name | None:
        for i, x in enumerate(tokens):
            g = tuple(sorted(self.given.get(x, ()))) if exact else self.given_of(x)
            if g:
                others = [y for j, y in enumerate(tokens) if j != i]
                long = [y for y in others if len(y) > 1]
                if not long:
                    return None
                last = long[-1] if i == 0 else long[0]
                middle = next((y[0] for y in others if y is not last), "")
                return Name(sound(last), [], "", g, middle)
        if not exact and len(tokens) >= 2 and len(tokens[0]) == 1 and len(tokens[-1]) > 3:  # "J. Smith"
            return Name(sound(tokens[-1]), [], "", (tokens[0] + "?",), tokens[1][0] if len(tokens) > 2 else "")
        return None


def _fit(one: list[str], two: list[str]) -> bool:
    """The same describing words, a word that is clipped past telling standing for any it may be."""
    if one == two:
        return True
    left = sorted(set(one) - set(two))
    right = sorted(set(two) - set(one))
    if len(one) != len(two) or len(left) != len(right):
        return False
    return all(any(x[-1] == "*" and (_clipped(x[:-1], y.rstrip("*")) or x[:-1] == y[: len(x) - 1]) or y[-1] == "*" and _clipped(y[:-1], x.rstrip("*")) for y in right) for x in left)


def likeness(a: Name, b: Name) -> tuple[int, str] | None:
    """Slips between the coined parts and how the rest agrees (full, initials, subset); null if something is against it.

    Two slips are forgiven only in long coined parts that begin alike, and only if all else is said in full and equal.
    """
    if a.person != b.person:
        return None
    n = min(len(a.coined), len(b.coined))
    far = distance(a.coined, b.coined, 2) if n >= 4 else 3 * (a.coined != b.coined)
    if far > 2 or far == 2 and (n < 7 or a.coined[0] != b.coined[0]) or far == 1 and n < 5:
        return None
    if a.person:
        first = any(x == y or ("?" in x + y and x[0] == y[0]) for x in a.given for y in b.given)
        return (far, "initials" if "?" in "".join(a.given + b.given) else "full") if first and (not a.middle or not b.middle or a.middle == b.middle) else None
    if sorted(a.initials) == sorted(b.initials) and _fit(a.words, b.words):
        return far, "full"
    if a.initials or b.initials:
        letters = lambda x: sorted([w[0] for w in x.words] + list(x.initials))
        full, short = (a, b) if len(a.words) >= len(b.words) else (b, a)
        return (far, "initials") if letters(a) == letters(b) and _fit(sorted(set(short.words) & set(full.words)), sorted(short.words)) else None
    one, two = sorted((a.words, b.words), key=len)
    return (far, "subset") if far == 0 and len(two) - len(one) == 1 and len(one) >= 1 and not set(one) - set(two) else None
