"""Problem 1: defective question-answer pairs and their kind of defect.

Plan
----
1. One Arrow pass profiles each pair: the answer without its JSON envelope, whether it says nothing,
   only repeats the question, declines, or is in a language the question neither uses nor asks for,
   and how it ends.  Names of files, links and numbers are masked, so that answers of one kind
   read alike.  What goes on is the masked answer, its last unit, and a few flags.
2. All distinct masked answers and units are sorted (one range exchange) and each is compared with
   its neighbour: in sorted order the extensions of a text follow it directly, so a text that its
   neighbour continues is a shortened version.  Texts that end in the middle of something enter
   whole and by their last unit and clause, with and without the last, possibly broken word.  First texts of a partition are
   handed to the partition before over a table of two rows a partition.
3. Length-limit spikes: lengths at which unfinished answers pile up, against the lengths on either side.
4. ``truncated`` is an answer with an unfinished ending that is a shortened version of others, sits at
   a spike, or leaves a structure open.  Rules for copies, refusals and languages give the others.

Order of precedence, so that no pair has two defects: empty, copy, refusal, truncated, language.
Defined results: a null answer is empty; with a null question neither copy nor language can be said;
answers too short to show a language are of none; a request_id delivered twice counts once.
"""

from __future__ import annotations

import difflib
import functools
import html
import json
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import materialize, ship
from tracelake.llm.endings import MARK, ending, final_unit

#: Texts that say nothing, compared without ink-free characters, marks and case.
FILLERS = frozenset(
    "|na|n a|none|null|nil|undefined|nan|empty|tbd|todo|placeholder|blank|no answer|no response|no output|no content|not available|not applicable|"
    "无|暂无|空|空白|无内容|无回答|无答案|略|待补充|占位|kosong|tidak tersedia|belum ada|sin respuesta|vacío|vacio|no disponible|pendiente|"
    "leer|keine antwort|kein inhalt|lorem ipsum|string|text|answer|response".split("|")
)
_ENVELOPE_KEYS = ("content", "answer", "text", "response", "output", "message", "result", "reply")
_TAGS = re.compile(r"<[^<>]{0,80}>|```[a-z]*|[\[\]{}()（）【】]")
_FILE = re.compile(r"[A-Za-z0-9][\w-]*\.[A-Za-z]{1,4}\d?\b|\b[a-z]+(?:_[a-z0-9]+)+\b")
_LINK = re.compile(r"https?://\S+")
_QUOTED = re.compile(r"\"[^\"\n]{0,80}\"|“[^”\n]{0,80}”|„[^“”\n]{0,80}[“”]|«[^»\n]{0,80}»|「[^」\n]{0,80}」|`[^`\n]{0,80}`")
_BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
_CLAUSE = re.compile(r"[,;:]\s+|[，、；：]\s*")
_UNIT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")

#: Function words by which a language in Latin letters shows.
WORDS = {
    "en": "the of and to in is that for with was were are this these those on by it you your have has had be been not from which there all an at as or now could still also please what how many no does whether every "
    "some any who only them they their where will can would should i we he she my our its do did but if when because about into over after before more most other such than then very here just",
    "id": "yang di dan untuk dengan ini itu dari pada tidak saya anda akan sudah telah ada dalam ke oleh bisa juga semua bila agar kepada sebagai berikut adalah atau berapa apakah tetap lalu tentang karena setiap hanya "
    "mereka kami kita dia jika seperti lebih tersebut belum masih harus dapat sangat setelah sebelum menjadi tanpa antara bagi serta maka namun tapi jadi lagi sama siapa apa mana kapan bagaimana tiap para ya",
    "es": "el la los las de del que y en un una para con por se no es al lo su sus como más pero ya está están hay este esta estos estas todos todas también cada cuántos qué si sí he ha han donde dónde cuando sobre entre "
    "sin hasta desde muy fue son ser era yo tú usted nos les le me te mi otro otra ahora porque quien cual ese esa eso hace o",
    "de": "der die das und in den von zu mit ist im für auf dem ein eine einen des sich nicht auch es an als wie sind wird wurde nach bei oder aus noch um wo ich habe alle ohne sie wir ihr er man kann aber wenn dass nur "
    "schon mehr sehr hier dort jetzt dann was wer welche diese dieser dieses jede jedes ja nein keine kein nun wurden werden hat haben war waren zum zur über unter vor durch gegen bitte ob daher so",
    "fr": "le la les des du de et en un une pour avec par sur dans est sont ne pas que qui ce cette ces il elle nous vous ils je tu au aux plus mais ou où si son sa ses leur comme été être avoir fait tout tous toutes très "
    "bien sans sous chez dont donc aussi entre après avant quand votre notre oui non",
    "it": "il lo la i gli le di del della dei delle che e in un una per con non è sono al alla come più ma anche questo questa questi queste tutti tutte ho hai ha abbiamo hanno nel nella sul sulla dal dalla si ci mi ti se "
    "dove quando perché chi cosa molto ancora già ora qui essere stato sua suo loro ogni senza tra fra dopo prima sì no",
    "pt": "o a os as de do da dos das que e em um uma para com não é são no na nos nas por mais mas também este esta isso isto todos todas foi ser está estão há seu sua seus ou se como quando onde quem muito já ainda agora "
    "eu você nós eles elas ao à pelo pela sem entre até depois antes cada foram tem têm sim",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er maar om ook als dan bij nog wel naar uit door over ze zij hij wij we ik je jij u mijn deze dit die was worden wordt werd heeft hebben had kan geen meer "
    "alle alleen nu hier daar waar wat wie hoe zo zonder tussen onder ja nee",
}
_WORD_LANGS: dict[str, tuple[str, ...]] = {}
for _l, _ws in WORDS.items():
    for _w in _ws.split():
        _WORD_LANGS[_w] = (*_WORD_LANGS.get(_w, ()), _l)
#: Characters by which a script shows, and how many of them are about a word.
SCRIPTS = {
    "zh": (r"[\u3400-\u9fff]", 2), "ja": (r"[\u3040-\u30ff]", 2), "ko": (r"[\uac00-\ud7af]", 2), "ru": (r"[\u0400-\u04ff]", 5), "el": (r"[\u0370-\u03ff]", 5), "ar": (r"[\u0600-\u06ff]", 4),
    "he": (r"[\u0590-\u05ff]", 4), "hi": (r"[\u0900-\u097f]", 4), "th": (r"[\u0e00-\u0e7f]", 5),
}
_SCRIPTS = {k: (re.compile(p), n) for k, (p, n) in SCRIPTS.items()}
#: Letters that few languages use.
_LETTERS = {"es": re.compile("[ñ¿¡]"), "de": re.compile("[ßä]"), "fr": re.compile("[œçêû]"), "pt": re.compile("[ãõ]"), "vi": re.compile("[ơưđ\u1ea0-\u1ef9]")}
_BEYOND_LATIN = re.compile("[\u0370-\u1dff\u2e80-\U0010ffff]")
#: Names of the languages in the languages, by which a question asks for one.
ASKED = {
    "en": r"英语|英文|\benglish\b|\binggris\b|\binglés\b|\bingles\b|\benglisch\w*",
    "zh": r"中文|汉语|普通话|华语|\bchinese\b|\bmandarin\b|\btionghoa\b|\bchino\b|\bchinesisch\w*",
    "id": r"印尼语|印度尼西亚语|印尼文|\bindonesian?\b|\bbahasa indonesia\b|\bindonesio\b|\bindonesisch\w*",
    "es": r"西班牙语|西班牙文|西语|\bspanish\b|\bspanyol\b|\bespañol\b|\bcastellano\b|\bspanisch\w*",
    "de": r"德语|德文|\bgerman\b|\bjerman\b|\balemán\b|\bdeutsch\w*",
    "fr": r"法语|法文|\bfrench\b|\bprancis\b|\bfrancés\b|\bfranzösisch\w*|\bfrançais\b",
    "it": r"意大利语|\bitalian\b|\bitalia\b|\bitaliano\b|\bitalienisch\w*",
    "pt": r"葡萄牙语|\bportuguese\b|\bportugis\b|\bportugués\b|\bportuguês\b|\bportugiesisch\w*",
    "nl": r"荷兰语|\bdutch\b|\bbelanda\b|\bneerlandés\b|\bniederländisch\w*|\bnederlands\b",
    "ru": r"俄语|俄文|\brussian\b|\brusia\b|\bruso\b|\brussisch\w*|русск",
    "ja": r"日语|日文|日本語|\bjapanese\b|\bjepang\b|\bjaponés\b|\bjapanisch\w*",
    "ko": r"韩语|韩文|한국어|\bkorean?\b|\bcoreano\b|\bkoreanisch\w*",
    "ar": r"阿拉伯语|العربية|\barabic\b|\barab\b|\bárabe\b|\barabisch\w*",
}
_ASKED = {k: re.compile(v, re.I) for k, v in ASKED.items()}
#: Ways to decline a whole task.
REFUSAL = re.compile(
    r"\bi(?:'d| would)? (?:rather|prefer) not\b|\bi(?:'d| would) prefer (?:not )?to (?:not )?\b|\b(?:have|need|going|want) to pass on (?:this|that|it)\b|\b(?:not going|not willing|unwilling|not inclined) to\b"
    r"|\b(?:can(?:no|')t|cannot|can not|won't|will not|(?:am|be|i'm) (?:un|not )able to|unable to|not able to)\b[^.!?\n]{0,40}\b(?:help|assist|do (?:this|that|it|so|what)|comply|carry out|"
    r"fulfil+|complete|provide|process|support|perform|answer|continue|proceed|accommodate|engage)"
    r"|\b(?:must|have to|need to|forced to) (?:decline|refuse)|\bi (?:decline|refuse)\b|\bsorry, (?:but )?no\b|^(?:sorry|apologies)[, ]+(?:i|but)\b"
    r"|\b(?:against|outside (?:of )?|beyond|violates?|not within) (?:my|what i am|what i'm|the|our) (?:guidelines?|polic\w+|rules|permitted|allowed|scope|principles|instructions)"
    r"|\bnot (?:permitted|allowed|authori[sz]ed|comfortable)\b|\bdon't feel comfortable|\bnot something i (?:am|can|could|may)|\bno (?:way|ability|permission) to (?:access|do|open)|\bas an? (?:ai|automated|language)"
    r"|(?:抱歉|对不起|很遗憾|不好意思)[^。！？]{0,12}(?:无法|不能|不可以|没法|没办法|做不了|帮不了|不便)|(?:无法|不能|没法|没办法|不可以)(?:协助|帮助|帮您|帮你|为您|满足|执行|完成|处理|提供|回答|继续)"
    r"|违反(?:了)?我?的?(?:准则|规定|政策|原则)|超出(?:了)?我?[^。]{0,8}(?:范围|权限|能力)|只能拒绝|(?:我|必须|不得不)(?:只能)?(?:拒绝|婉拒)|我不会(?:继续|这样做|执行|处理)|作为(?:一个|一名)?[^。]{0,8}(?:助手|AI|人工智能|模型)[^。]{0,8}不能|这件事我不能|不允许我|我不被允许|我不方便"
    r"|\b(?:tidak (?:bisa|dapat|mampu|boleh)) (?:membantu|melakukan|menjalankan|memenuhi|menyelesaikan|memproses|melanjutkan|menjawab|mengerjakan)|\b(?:harus|terpaksa) menolak|\bsaya menolak|di luar (?:wewenang|kemampuan|batas)|melanggar (?:pedoman|aturan|kebijakan)|tidak (?:punya|memiliki) (?:akses|cara|izin|kemampuan)|^(?:maaf|sayangnya)[, ]+(?:saya |tidak)|tidak (?:nyaman|diizinkan|diperbolehkan)|sebagai asisten"
    r"|\bno (?:puedo|podré|podría|me es posible|voy a poder|soy capaz)\b[^.!?\n]{0,30}\b(?:ayudar\w*|hacer\w*|realizar\w*|cumplir\w*|atender\w*|ejecutar\w*|completar\w*|procesar\w*|asistir\w*|responder\w*|continuar)|debo (?:negarme|rechazar|declinar)|\b(?:me niego|rechazo)\b|contra (?:mis|las) (?:normas|reglas|pautas|directrices|políticas)|fuera de (?:lo que tengo|mi|mis)|no (?:tengo|dispongo de) (?:acceso|permiso|forma|manera|autorización|modo)|no (?:me está permitido|estoy autorizad\w|me siento cómod\w)|\blo siento, (?:pero )?no\b|como asistente"
    r"|\b(?:kann|könnte|darf|werde|möchte)\b[^.!?\n]{0,50}\bnicht\b[^.!?\n]{0,30}(?:helfen|tun|ausführen|erfüllen|bearbeiten|machen|unterstützen|erledigen|weiterhelfen|fortfahren|fortsetzen|weitermachen|beantworten|nachkommen)|\bnicht (?:helfen|weiterhelfen|ausführen|erlaubt|gestattet|befugt|zulässig)\b|muss (?:ich )?(?:\w+ )?ablehnen|\blehne\b[^.!?\n]{0,30}\bab\b|gegen meine (?:richtlinien|regeln|vorgaben)|verstößt gegen|außerhalb (?:dessen|meiner)|kein(?:e|en)? (?:zugriff|möglichkeit|befugnis|zugang)|als (?:automatischer |ki-)?assistent|leider (?:nein|kann ich)",
    re.I,
)
#: Strings of which every way to decline has one.
_DECLINES = (
    "n't", "not", "unable", "unwilling", "prefer", "pass on", "declin", "refus", "sorry", "apolog", "against", "outside", "beyond", "violat", "no way", "no ability", "no permission", "as a", "无法", "不能", "不可以", "没法", "没办法",
    "做不了", "帮不了", "不便", "违反", "超出", "拒绝", "婉拒", "不会", "作为", "不允许", "不被允许", "不方便", "tidak", "menolak", "luar", "melanggar", "maaf", "sayangnya", "sebagai", "no ", "neg", "rechaz", "niego", "contra", "fuera",
    "siento", "como asis", "nicht", "ablehn", "lehne", "gegen", "verstö", "außerhalb", "kein", "assistent", "leider",
)
#: Units that may stand beside a refusal without making it an answer.
_POLITE = re.compile(
    r"\?\s*$|？\s*$|\b(?:contact|administrator|have a nice|good day|thanks?|thank you|let me know|instead|please|comfortable|apolog)|管理员|谢谢|感谢|祝您|请联系|hubungi|terima kasih|semoga|administrator|contacta|contacte|gracias|buen día|que tenga"
    r"|wende|administrator|danke|schönen tag|bitte wenden|kontaktier",
    re.I,
)
_LABEL = re.compile(
    r"^(?:the )?(?:question|query|task|prompt|request|you asked(?: me)?(?: to| for)?|your request(?: was| is)?|user|q|a|answer|re|问题|问|您的要求是|您问的是|您的问题是|任务|请求|用户|答|pertanyaan|permintaan anda|anda meminta|tugas|pregunta|pediste|tu petición|petición|solicitud|"
    r"frage|deine bitte|aufgabe|anfrage|ihre anfrage)+$",
    re.I,
)


def unwrap(answer: str | None) -> tuple[str, bool]:
    """(text of the answer without its JSON envelope, whether the envelope never closes)."""
    a = answer or ""
    s = a.strip()
    if s[:1] != "{" and not (s[:1] == '"' and s[-1:] == '"' and len(s) > 1):
        return a, False
    try:
        o = json.loads(s)
    except ValueError:
        m = re.match(r'\{\s*"(\w+)"\s*:\s*"', s)
        if m:
            body = s[m.end() :]
            try:
                return json.loads('"' + body.rstrip("\\").replace('"', '\\"') + '"'), True
            except ValueError:
                return body, True
        return a, s[:1] == "{" and not s.endswith("}")
    if isinstance(o, str):
        return o, False
    if isinstance(o, dict):
        for k in _ENVELOPE_KEYS:
            if k in o:
                v = o[k]
                return ("" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)), False
        return ("" if not o else a), False
    return a, False


_INK = re.compile(r"[^\W_]+")
_LONGEST_FILLER = max(map(len, FILLERS))


def says_nothing(text: str) -> bool:
    t = unicodedata.normalize("NFKC", html.unescape(text) if "&" in text else text).casefold()
    t = _TAGS.sub(" ", t)
    # More letters than any filler has: no need to look at every character.
    if sum(map(len, _INK.findall(t))) > _LONGEST_FILLER:
        return False
    t = "".join(" " if unicodedata.category(c)[0] in "PZC" or c in "`~^|+=<>$" else c for c in t)
    return " ".join(t.split()) in FILLERS


def plain(text: str) -> str:
    """Letters and digits only, without case and width."""
    return "".join(_INK.findall(unicodedata.normalize("NFKC", text).casefold()))


#: Questions come with many answers each, so what is computed on one is kept.
_plain_question = functools.lru_cache(maxsize=4096)(plain)


def repeats_question(q: str, a: str) -> bool:
    pq, pa_ = _plain_question(q), plain(a)
    if len(pq) < 4 or not pa_:
        return False
    if pq in pa_:
        rest = pa_.replace(pq, "")
        return not rest or bool(_LABEL.match(rest)) or (len(rest) < len(pq) and rest in pq and len(rest) <= 2)
    if abs(len(pq) - len(pa_)) > 0.06 * len(pq) + 1:
        return False
    # The same question with a few characters changed; answers reword, so they fall well below.
    return difflib.SequenceMatcher(None, pq, pa_, autojunk=False).ratio() >= 0.97


_LATIN = re.compile(r"[^\W\d_\u0370-\u1dff\u2e80-\U0010ffff]+")


def is_refusal(text: str) -> bool:
    """Every unit declines or is polite beside it; a setback among results is none."""
    t = unicodedata.normalize("NFKC", text).replace("’", "'").strip()
    hit = False
    # Unit by unit, so that a text that gives a result is left at its first sentence.
    at = 0
    while at < len(t):
        m = _UNIT.search(t, at)
        unit, at = (t[at : m.start()], max(m.end(), at + 1)) if m else (t[at:], len(t))
        u = _FILE.sub("file", _LINK.sub("", unit)).strip(" \t\n-*•\"'“”")
        if not u:
            continue
        low = u.lower()
        if any(x in low for x in _DECLINES) and REFUSAL.search(u):
            hit = True
        elif not _POLITE.search(u) and len(u) > 12:
            return False
    return hit


def languages(text: str) -> dict[str, float]:
    """Evidence per language in words: scripts, letters and function words, outside quotes and file names."""
    t = _QUOTED.sub(" ", _FILE.sub(" ", _LINK.sub(" ", text)))
    t = unicodedata.normalize("NFKC", t).casefold()
    score: dict[str, float] = {}
    if not t.isascii() and _BEYOND_LATIN.search(t):
        for lang, (r, n) in _SCRIPTS.items():
            if k := len(r.findall(t)):
                score[lang] = k / n
        if "ja" in score:  # Kana are the part of Japanese that Chinese lacks.
            score["ja"] += score.pop("zh", 0.0)
    known = Counter(_LATIN.findall(t))
    for w, k in known.items():
        ls = _WORD_LANGS.get(w, ())
        for lang in ls:
            score[lang] = score.get(lang, 0.0) + k / len(ls)
        if not w.isascii():
            for lang, r in _LETTERS.items():
                if r.search(w):
                    score[lang] = score.get(lang, 0.0) + 0.5 * k
    return score


_question_languages = functools.lru_cache(maxsize=4096)(languages)


def wrong_language(q: str, a: str) -> bool:
    sa = languages(a)
    if not sa:
        return False
    best = max(sa, key=lambda k: (sa[k], k))
    if sa[best] < 2.0 and not (len(a) < 40 and sa[best] >= 1.0 and len(sa) == 1):
        return False
    sq = _question_languages(q)
    if not sq:
        return False
    top = max(sq.values())
    uses = {k for k, v in sq.items() if v >= max(1.0, 0.5 * top)}
    if best in uses:
        return False
    ok = uses | {k for k, r in _ASKED.items() if r.search(q)}
    if best in ok:
        return False
    return sa[best] >= 2.0 * max([sa.get(k, 0.0) for k in ok], default=0.0) + 0.5


def mask(text: str) -> str:
    t = _LINK.sub("L", text)
    t = _FILE.sub("F", t)
    return re.sub(r"\d+", "0", t).strip()


def is_open(core: str, envelope_open: bool) -> tuple[bool, bool]:
    """(ends in the middle of something, leaves a structure open)."""
    state, why, _ = ending(core)
    if envelope_open:
        return True, True
    if state != "open":
        return False, False
    if why in ("structure",):
        return True, True
    c = core.strip()
    # Bare answers to short questions have no sentence to finish.
    if why != "mark" and "\n" not in c and (len(c.split()) <= 2 and len(c) <= 30 and not re.search(r"[㐀-鿿]{6,}", c)):
        return False, False
    return True, False


_PROFILE = "request_id string, defect string, is_open boolean, structure boolean, n_chars int, masked string, probes array<string>"
_PROFILE_ARROW = pa.schema(
    [("request_id", pa.string()), ("defect", pa.string()), ("is_open", pa.bool_()), ("structure", pa.bool_()), ("n_chars", pa.int32()), ("masked", pa.string()), ("probes", pa.list_(pa.string()))]
)


def profile(question: str | None, answer: str | None):
    """(defect or None, is_open, structure, n_chars, masked, probes) of one pair."""
    core, env_open = unwrap(answer)
    n = len(answer or "")
    if says_nothing(core):
        return "empty", False, False, n, None, None
    if question and repeats_question(question, core):
        return "copy", False, False, n, None, None
    if is_refusal(core):
        return "refusal", False, False, n, None, None
    opened, structure = is_open(core, env_open)
    defect = "language" if question and wrong_language(question, core) else None
    return defect, opened, structure, n, mask(core), probes(core) if opened else None


def probes(core: str) -> list[str]:
    """The unfinished answer, its last unit and last clause, each whole and without a broken word."""
    end = MARK.sub("", core.rstrip()).rstrip()
    unit = _BULLET.sub("", final_unit(end)).strip()
    clause = _CLAUSE.split(unit)[-1].strip()
    out = [mask(end)]
    for x in (unit, clause):
        whole = re.sub(r"\S+\Z", "", x).rstrip() if " " in x else x[:-1]
        out += [mask(x), mask(whole), mask(re.sub(r"[A-Za-z_0-9.]+\Z", "", x).rstrip())]
    return list(dict.fromkeys(x for x in out if x))


def _profiles(batches):
    for b in batches:
        rows = [(r, *profile(q, a)) for r, q, a in zip(*[b.column(c).to_pylist() for c in ("request_id", "question", "answer")])]
        cols = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PROFILE_ARROW)], schema=_PROFILE_ARROW)


_NEIGH = pa.schema([("text", pa.string()), ("shortened", pa.bool_()), ("border", pa.string()), ("part", pa.int32())])


def continues(text: str, following: str | None) -> bool:
    """Whether ``following`` is ``text`` and then some words or letters more."""
    return following is not None and following.startswith(text) and sum(c.isalnum() for c in following[len(text) :]) >= 2


#: Share of a text that must agree with a sorted neighbour which continues it in other words, and its least length.
NEAR_SHARE, NEAR_LEAST = 0.6, 12


def common_prefix(a: str, b: str | None) -> int:
    if b is None:
        return 0
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def runs_on(text: str, other: str | None) -> bool:
    """Whether a neighbour goes the same way for most of the text and is longer behind the fork."""
    if other is None or len(text) < NEAR_LEAST:
        return False
    k = common_prefix(text, other)
    return NEAR_SHARE * len(text) <= k < len(text) and len(other) - k > len(text) - k + 2


def _neighbours(batches):
    part, pending, first, prev = TaskContext.get().partitionId(), [], True, None
    for b in batches:
        out = []
        for text, asked in zip(b.column("text").to_pylist(), b.column("asked").to_pylist()):
            # Extensions of a text follow it directly, so the texts still waiting are nested prefixes.
            while pending and not text.startswith(pending[-1]):
                x = pending.pop()
                if runs_on(x, text):
                    out.append((x, True, None, part))
            waiting = []
            for x in pending:
                if continues(x, text):
                    out.append((x, True, None, part))
                else:
                    waiting.append(x)
            pending = waiting
            if first:
                out.append((text, asked, "first", part))
                first = False
            if asked:
                if runs_on(text, prev):
                    out.append((text, True, None, part))
                else:
                    pending.append(text)
            prev = text
        yield _neigh_batch(out)
    yield _neigh_batch([(x, False, "waiting", part) for x in pending] + ([(prev, False, "last", part)] if not first else []))


def _neigh_batch(rows):
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NEIGH)], schema=_NEIGH)


def shortened_texts(texts: DataFrame, name: str = "neighbours") -> DataFrame:
    """(text, asked) distinct texts -> texts asked for that their sorted neighbour continues."""
    ordered = texts.repartitionByRange("text").sortWithinPartitions("text")
    near = materialize(ordered.mapInArrow(_neighbours, "text string, shortened boolean, border string, part int"), name)
    inside = near.where("border is null and shortened").select("text")
    # A first and a last text a partition, and the few nested prefixes that still wait at its end.
    edge = near.where("border is not null")
    w = Window.orderBy("part", F.when(F.col("border") == "first", 0).when(F.col("border") == "waiting", 1).otherwise(2))
    following = F.first(F.when(F.col("border") == "first", F.col("text")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(F.when(F.col("border") == "last", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.withColumn("other", F.when(F.col("border") == "waiting", following).when((F.col("border") == "first") & F.col("shortened"), before))
    return inside.unionByName(edge.where("other is not null").select("text", "border", "other").mapInArrow(_edges, "text string"))


def _edges(batches):
    for b in batches:
        rows = zip(*[b.column(c).to_pylist() for c in ("text", "border", "other")])
        kept = [t for t, border, o in rows if runs_on(t, o) or border == "waiting" and continues(t, o)]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["text"])


#: A length is a spike if it has so many times the mean of the WIDTH lengths on either side (itself left out, absent lengths
#: count zero) and lies so many of its random deviations above it.
SPIKE_RATIO, SPIKE_WIDTH, SPIKE_DEVIATIONS = 5, 10, 6


def length_spikes(at: DataFrame) -> DataFrame:
    """(n_chars, n_at) unfinished answers per length -> lengths that stand out of their neighbourhood."""
    near = at.select(F.explode(F.sequence(F.col("n_chars") - SPIKE_WIDTH, F.col("n_chars") + SPIKE_WIDTH)).alias("n_chars"), F.col("n_at").alias("n_near"))
    near = near.groupBy("n_chars").agg(F.sum("n_near").alias("n_near"))
    beside = (F.col("n_near") - F.col("n_at")) / (2 * SPIKE_WIDTH)
    stands_out = (F.col("n_at") >= SPIKE_RATIO * beside) & (F.col("n_at") >= beside + SPIKE_DEVIATIONS * F.sqrt(beside + 1))
    return at.join(near, "n_chars").where(stands_out).select("n_chars")


def judge_pairs(rollouts: DataFrame) -> DataFrame:
    """(request_id, defect, evidence) for every rollout; defect is null for a sound pair."""
    ship(rollouts.sparkSession)
    src = rollouts.where("request_id is not null").select("request_id", "question", "answer")
    p = materialize(src.mapInArrow(_profiles, _PROFILE), "pairs")
    units = F.transform(F.split("masked", r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+"), lambda u: F.regexp_replace(u, r"^\s*(?:[-*•]|\d+[.)])\s+", ""))
    clauses = F.flatten(F.transform(units, lambda u: F.split(u, r"[,;:]\s+|[，、；：]\s*")))
    corpus = p.where("masked is not null").select(F.explode(F.array_union(F.array("masked"), F.array_union(units, clauses))).alias("text"), F.lit(False).alias("asked"))
    probes_ = p.where("is_open").select(F.explode("probes").alias("text"), F.lit(True).alias("asked"))
    texts = corpus.unionByName(probes_).where(F.length("text") >= 1).groupBy("text").agg(F.max("asked").alias("asked"))
    short = shortened_texts(texts).distinct()
    open_ = p.where("is_open").select("request_id", "structure", "n_chars", F.explode_outer("probes").alias("text"))
    hit = open_.join(short.withColumn("hit", F.lit(True)), "text", "left").groupBy("request_id").agg(
        F.max("structure").alias("structure"), F.max("n_chars").alias("n_chars"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("shortened")
    )
    at = p.where("is_open").groupBy("n_chars").agg(F.count_distinct("request_id").alias("n_at"))
    spikes = length_spikes(at).withColumn("spike", F.lit(True))
    cut = hit.join(spikes, "n_chars", "left").select("request_id", "structure", "shortened", F.coalesce("spike", F.lit(False)).alias("spike"))
    d = p.select("request_id", "defect", "is_open").dropDuplicates(["request_id"]).join(cut, "request_id", "left")
    truncated = F.col("is_open") & (F.col("structure") | F.col("shortened") | F.col("spike"))
    evidence = F.array_join(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("structure", "shortened", "spike")])), "+")
    kind = F.when(F.col("defect").isin("empty", "copy", "refusal"), F.col("defect")).when(truncated, "truncated").otherwise(F.col("defect"))
    return d.select("request_id", kind.alias("defect"), "is_open", F.when(truncated, evidence).alias("evidence"))


def found(rollouts: DataFrame) -> DataFrame:
    return judge_pairs(rollouts).where("defect is not null").select("request_id", "defect")
