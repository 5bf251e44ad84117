"""Marker families: patterns whose matches in a turn are counted."""

from __future__ import annotations

import re
from functools import cache
from itertools import groupby
from re import _parser as parser

NOT_A_BACK_REFERENCE = r"(?<!\bfor )(?<!\bin )(?<!\bof )(?<!\bsee )(?<!\bstep )"

# --- Fixed values: the patterns of the marker families, by family -----------------------------

SHARED = {
    "revision": [r"\binstead\b", r"\bactually\b", r"\btry again\b", r"\bthat'?s not\b", r"\brewrite\b", r"\bshorter\b", r"\blonger\b", r"\bmore specific\b", r"\bsame but\b", r"\bredo\b", r"\blet'?s try\b", r"\bcloser but\b", r"\bnot quite\b"],
    "success_cond": [r"\bso (?:that )?i can\b", r"\bso i can\b", r"\bthe (?:output|result) i need\b", r"\bi(?:'|’)?m trying to\b", r"\bgoal is\b", r"\bin order to\b"],
    "request_head": [
        r"^\s*(?:please\s+)?(?:write|draft|list|explain|summari[sz]e|compare|give|make|create|generate|outline|analy[sz]e|translate|rewrite|fix|check|find|suggest|help|implement|parallelis|parallelize|optimi[sz]e|debug|profile|port)\b",
        r"\bcan you\b", r"\bcould you\b", r"\bwould you\b", r"\bi need you to\b",
    ],
    "enumeration": [
        r"^\s*\d+[.)]\s", r"^\s*[-*•]\s", r"\bfirst(?:ly)?\b.*\bsecond(?:ly)?\b", NOT_A_BACK_REFERENCE + r"(?<![\w\])])\(\s*\d{1,2}\s*\)(?=\s)",
        NOT_A_BACK_REFERENCE + r"(?<![\w\])])\([a-h]\)(?=\s)", r"(?<=[:;,]\s)\d{1,2}\)\s", r"\btwo things\b", r"\bthree things\b", r"\bpart (?:one|two|1|2)\b",
    ],
    "sequence": [r"\bfirst\b", r"\bthen\b", r"\bnext\b", r"\bafter that\b", r"\bbefore (?:we|i|that)\b", r"\bonce (?:we|i|that|you)\b", r"\bstep \d\b", r"\bfinally\b", r"\blater\b", r"\bsubsequently\b"],
    "scope": [r"\bjust\b", r"\bonly the\b", r"\bfor now\b", r"\bto start\b", r"\blimit(?:ed)? to\b", r"\bnarrow(?:ed)? (?:down|to)\b", r"\bone (?:section|part|piece|function|kernel|loop)\b", r"\bset(?:ting)? aside\b", r"\bwe'?ll (?:get to|come back)\b"],
    "limitation": [
        r"\byou (?:can'?t|cannot|don'?t have) (?:access|see|browse|know|run|compile)\b", r"\byour (?:training|knowledge) (?:data|cut)", r"\bcut-?off\b", r"\bsince you can'?t\b", r"\byou might (?:not know|make up|hallucinat)",
        r"\bhallucinat", r"\bno access to\b", r"\bup-?to-?date\b", r"\bmake (?:something|it) up\b", r"\byou can'?t (?:see|run) (?:my|the) (?:cluster|machine|output|hardware)\b",
    ],
    "hedge": [r"\bare you sure\b", r"\bis that right\b", r"\bdouble-?check\b", r"\bnot sure (?:that|this|about)\b", r"\bseems? (?:off|odd|wrong)\b", r"\bverify\b", r"\bconfirm\b", r"\bcan i trust\b", r"\bsceptical\b", r"\bskeptical\b"],
    "why_how": [r"\bwhy\b", r"\bhow (?:does|do|would|did|is)\b", r"\bwhat makes\b", r"\bexplain (?:why|how)\b", r"\bwhat'?s the (?:reasoning|mechanism|logic)\b", r"\bwalk me through\b"],
    "disagreement": [r"\bi (?:disagree|don'?t think|doubt)\b", r"\bi'?m not convinced\b", r"\bbut that (?:ignores|misses)\b", r"\bi still think\b", r"\bmy reading (?:is|was)\b", r"\bpush back\b", r"\bi'?d argue\b", r"\bthat contradicts\b"],
    "allocation": [r"\bi'?ll (?:do|handle|write|analy[sz]e|take|run|compile|test)\b", r"\byou (?:do|handle|draft|take|write)\b", r"\bi'?ll (?:leave|keep) (?:that|this)\b", r"\bmyself\b", r"\bon my own\b", r"\bi want to (?:do|write) (?:that|this|it)\b"],
    "shared_artifact": [
        r"\bour (?:draft|report|code|repo|branch|section|analysis|project|submission)\b", r"\bthe team\b", r"\bmy (?:teammate|group|partner|lab partner)",
        r"\bwe'?(?:ll|re) (?:writing|adding|putting|submitting|pushing)\b", r"\bgroup (?:deliverable|submission|report|assignment)\b",
    ],
}

GENERAL = SHARED | {
    "constraint": [
        r"\bin (?:under|no more than|at most|exactly|about) \d+", r"\b\d+\s*(?:words|sentences|bullets|pages|paragraphs|items)\b", r"\bas (?:a|an) (?:table|list|bullet|outline|email|memo|abstract)\b", r"\bformat(?:ted)? as\b",
        r"\bfor (?:a|an) (?:lay|general|expert|undergraduate|clinical|executive) (?:reader|audience)\b", r"\bdon'?t include\b", r"\bwithout (?:using|mentioning)\b", r"\bavoid\b", r"\btone\b", r"\bact as\b", r"\byou are (?:a|an)\b", r"\bonly (?:use|include|cover)\b",
    ],
    "external_source": [
        r"\baccording to\b", r"\bi (?:looked|checked|read|found)\b", r"\bthe (?:textbook|paper|article|syllabus|guideline|standard|manual|docs?)\b", r"\bmy (?:notes|professor|instructor|lecture)\b",
        r"\bpubmed\b", r"\bgoogle scholar\b", r"\bi verified\b", r"\bcross-?check", r"\bon the (?:cdc|who|nih|sec|irs) (?:site|website)\b",
    ],
    "error_assert": [
        r"\bthat'?s (?:wrong|incorrect|not right|false)\b", r"\byou (?:got|have) (?:that|it|this) wrong\b", r"\bthis is (?:wrong|inaccurate|incorrect)\b", r"\bdoesn'?t (?:exist|match)\b", r"\bmade (?:that|this|it) up\b",
        r"\bmisquot", r"\bactually it'?s\b", r"\bno,? (?:it|that|the)\b", r"\bcontradicts\b", r"\bthat citation\b",
    ],
    "provenance": [
        r"\bcite\b", r"\bcitation", r"\bsource(?:s)?\b", r"\bwhere did (?:you|that) (?:get|come)\b", r"\bhow do you know\b", r"\bwhat'?s (?:your|the) (?:basis|evidence)\b", r"\breference(?:s)?\b",
        r"\bshow (?:me )?your (?:work|reasoning)\b", r"\bis that (?:peer-?reviewed|documented)\b",
    ],
    "recheck": [r"\bnow (?:check|verify|confirm)\b", r"\bdid (?:that|you) fix\b", r"\bis (?:it|that) (?:right|correct) now\b", r"\bre-?check\b", r"\bstill (?:wrong|off)\b", r"\bbetter now\b", r"\bconfirm(?:ed)? (?:the|that) (?:fix|correction)\b"],
    "ethics": [
        r"\bethic", r"\bconsent\b", r"\bprivacy\b", r"\bconfidential", r"\bbias(?:ed)?\b", r"\bfair(?:ness)?\b", r"\bharm\b", r"\bplagiaris", r"\bacademic integrity\b", r"\bdisclos",
        r"\bhipaa\b", r"\bferpa\b", r"\bde-?identif", r"\banonymi[sz]", r"\bstakeholder", r"\bvulnerable\b", r"\bequit(?:y|able)\b",
    ],
    "privacy": [r"\bprivacy\b", r"\bconfidential", r"\bhipaa\b", r"\bferpa\b", r"\bde-?identif", r"\banonymi[sz]", r"\bredact", r"\bi'?ve removed (?:the )?(?:names?|identifiers?)\b", r"\bno (?:real )?names?\b", r"\bpseudonym", r"\bpersonal(?:ly)? identif"],
    "bias": [r"\bbias(?:ed|es)?\b", r"\bstereotyp", r"\brepresentative\b", r"\bwhose perspective\b", r"\bleft out\b", r"\bmissing (?:voices?|perspectives?|groups?)\b", r"\bwestern\b", r"\bskew"],
    "stakeholder": [r"\bpatient", r"\bclient", r"\bcustomer", r"\bparticipant", r"\bcommunity\b", r"\bstakeholder", r"\bwho (?:is|would be) affected\b", r"\bimpact on\b", r"\bfor the (?:reader|user|nurse|teacher)\b", r"\bend users?\b"],
    "attribution": [r"\bcite (?:you|this|the ai|chatgpt|claude)\b", r"\bdisclos", r"\backnowledg", r"\bmy own words\b", r"\bi'?ll rewrite\b", r"\bplagiaris", r"\bai-?(?:generated|assisted)\b", r"\bhand (?:this|it) in\b", r"\battribut"],
    "reconcile": [
        r"\bon the other hand\b", r"\bbut (?:the|my) (?:textbook|professor|article|notes|data)\b", r"\bconflicts? with\b", r"\bcontradicts\b", r"\bwhereas\b", r"\bboth (?:say|claim|suggest)\b", r"\breconcile\b", r"\bdisagrees? with\b",
        r"\bcombin(?:e|ing) (?:that|this|your|both)\b", r"\bmy (?:teammate|group|partner)\b",
    ],
}

HPC = SHARED | {
    "constraint": [
        r"\bin (?:under|no more than|at most|exactly|about) \d+", r"\b\d+\s*(?:lines|threads|ranks|processes|blocks|warps|iterations)\b", r"\b(?:using|with|in) (?:mpi|openmp|cuda|openacc|pthreads|hip|sycl|kokkos)\b", r"\bc\+\+\d*\b", r"\bfortran\b",
        r"\bcompile[sd]? with\b", r"\b-O[0-3]\b", r"\bwithout (?:using|changing|modifying)\b", r"\bdon'?t (?:change|use|add)\b", r"\bkeep the (?:signature|interface|api|loop structure)\b", r"\bmust (?:be|remain) (?:thread-?safe|deterministic|reproducible)\b",
        r"\bonly (?:use|include|modify|change)\b", r"\bact as\b", r"\byou are (?:a|an)\b",
    ],
    "external_source": [
        r"\baccording to\b", r"\bi (?:looked|checked|read|found|ran|tested|compiled|profiled)\b", r"\bthe (?:docs?|documentation|man ?page|standard|spec|textbook|slides?)\b", r"\b(?:mpi|openmp|cuda|nvidia|intel) (?:docs?|documentation|guide|manual|spec)\b",
        r"\bmy (?:notes|professor|instructor|ta|lecture)\b", r"\bserial (?:version|baseline|reference|implementation)\b", r"\bagainst the (?:reference|baseline|known)\b", r"\bi verified\b", r"\bcross-?check", r"\bstack ?overflow\b",
        r"\bvalgrind\b", r"\bnvprof\b", r"\bnsight\b", r"\bgdb\b", r"\bperf\b", r"\bsanitizer\b", r"\bgprof\b",
    ],
    "error_assert": [
        r"\bthat'?s (?:wrong|incorrect|not right)\b", r"\bdoesn'?t (?:compile|build|link|run)\b", r"\bsegfault", r"\bsegmentation fault\b", r"\bcore dump", r"\bdeadlock", r"\bhangs?\b", r"\brace condition\b", r"\bwrong (?:answer|result|output|value)s?\b",
        r"\bmismatch(?:es)?\b", r"\bdiverges?\b", r"\bnan\b", r"\boff by\b", r"\bslower than (?:the )?serial\b", r"\bno speed-?up\b", r"\bthat api doesn'?t exist\b", r"\bundefined (?:reference|behavior|behaviour)\b", r"\bcompiler error\b",
        r"\bit returns? (?:the )?wrong\b", r"\bactually it'?s\b",
    ],
    "provenance": [
        r"\bwhy (?:does|do|is) (?:that|this|it)\b", r"\bhow do you know\b", r"\bwhat'?s (?:your|the) (?:basis|reasoning)\b", r"\bshow (?:me )?your (?:work|reasoning)\b", r"\bwhich (?:standard|version|spec)\b", r"\bis that in the (?:standard|spec|docs?)\b",
        r"\bcite\b", r"\bsource(?:s)?\b", r"\breference(?:s)?\b", r"\bwhere (?:in the docs?|does the standard)\b", r"\bexplain (?:the|that) (?:pragma|directive|clause|flag)\b",
    ],
    "recheck": [
        r"\bnow (?:check|verify|confirm|run|test|profile)\b", r"\bdid (?:that|you) fix\b", r"\bis (?:it|that) (?:right|correct) now\b", r"\bre-?(?:check|run|test|compile|profile)\b", r"\bstill (?:wrong|off|slow|failing|hangs?)\b", r"\bbetter now\b",
        r"\bpasses now\b", r"\bmatches (?:the )?(?:serial|reference|baseline)\b", r"\bspeed-?up is now\b",
    ],
    "ethics": [
        r"\bethic", r"\bacademic integrity\b", r"\bplagiaris", r"\bdisclos", r"\bcite (?:the )?ai\b", r"\bhonor code\b", r"\ballowed to use\b", r"\bpermitted\b", r"\bcourse policy\b", r"\blicen[cs]e\b", r"\bgpl\b", r"\bmy own work\b",
        r"\bsubmit(?:ting)? (?:this|it) as\b", r"\bshared (?:cluster|allocation|node)\b", r"\bcompute (?:budget|allocation|quota)\b", r"\benergy (?:cost|use|budget)\b", r"\bcarbon\b", r"\bfair (?:share|use)\b",
    ],
    "privacy": [
        r"\bprivacy\b", r"\bconfidential", r"\bproprietary\b", r"\bnda\b", r"\bunpublished\b", r"\bcredential", r"\bapi key\b", r"\bpassword\b", r"\bssh key\b", r"\bi'?ve removed\b", r"\bredact", r"\banonymi[sz]",
        r"\bcan'?t (?:share|paste) (?:the )?(?:real|full)\b", r"\bsanitis(?:e|ed)\b", r"\bsanitiz(?:e|ed)\b",
    ],
    "bias": [
        r"\bbias(?:ed|es)?\b", r"\brepresentative\b", r"\bbenchmark (?:choice|selection)\b", r"\bcherry-?pick", r"\bonly (?:tested|measured) (?:on|with)\b", r"\bedge case", r"\bdoes (?:that|this) generali[sz]e\b",
        r"\bwhat about (?:other|larger|smaller)\b", r"\bproblem size\b", r"\bsingle (?:run|trial|measurement)\b", r"\bvariance (?:across|between) runs\b",
    ],
    "stakeholder": [
        r"\bother users?\b", r"\bshared (?:cluster|system|queue|node)\b", r"\bqueue\b", r"\bwho (?:is|would be) affected\b", r"\bimpact on\b", r"\bdownstream\b", r"\bwhoever (?:maintains|reads|runs)\b", r"\bmaintainer", r"\bthe grader\b",
        r"\bfuture me\b", r"\bnext (?:person|student)\b", r"\bproduction\b", r"\bend users?\b",
    ],
    "attribution": [
        r"\bcite (?:you|this|the ai|chatgpt|claude|copilot)\b", r"\bdisclos", r"\backnowledg", r"\bmy own (?:words|work|code)\b", r"\bi'?ll rewrite\b", r"\bplagiaris", r"\bai-?(?:generated|assisted)\b", r"\bhand (?:this|it) in\b", r"\battribut",
        r"\bcomment (?:saying|noting) (?:this|it) (?:was|came)\b", r"\bheader comment\b",
    ],
    "reconcile": [
        r"\bon the other hand\b", r"\bbut (?:the|my) (?:docs?|profiler|output|notes|data|serial|baseline)\b", r"\bconflicts? with\b", r"\bcontradicts\b", r"\bwhereas\b", r"\bboth (?:say|claim|suggest)\b", r"\breconcile\b", r"\bdisagrees? with\b",
        r"\bcombin(?:e|ing) (?:that|this|your|both)\b", r"\bmy (?:teammate|group|partner|lab partner)\b", r"\bthe profiler (?:says|shows|reports)\b", r"\bnvprof (?:says|shows)\b", r"\bdoesn'?t match what (?:i|the)\b",
    ],
}

STOPWORDS = """a an the and or but if then than that this these those of in on at to for with from by as is are was were be been
being do does did doing have has had having i you it its it's we they he she them his her their our your my me not no yes so very just
really can could would should will shall may might must about into over under out up down more most some any all what which who whom
how when where why there here also too only even still much many few own same other another each both""".split()
VAGUE = """stuff thing things something anything nice good better best bad great professional appropriate proper fine ok okay
interesting relevant stuff-like whatever etc improve improved awesome quality general normal basic simple""".split()

PII = {
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b",
    "phone": r"(?<!\d)(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    "ssn_like": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "record_id": r"(?i)\b(?:MRN|DOB|patient\s*(?:id|#)|student\s*id)\b[:# ]*\S*",
    "dob_like": r"(?<!\d)(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12]\d|3[01])/(?:19|20)\d{2}(?!\d)",
    "url": r"https?://\S+",
}

# --- End of the fixed values ------------------------------------------------------------------

PROFILES = {"general": GENERAL, "hpc": HPC}
#: Case-insensitive in Unicode, `^` after \n alone, and Unicode classes.
FLAGS = "(?imdU)"
#: The same with RE2's classes, which the queries' SQL has: words, digits and spaces are of ASCII, but case is Unicode's.
RE2_FLAGS = "(?imdu)"
_RE2 = {
    r"[\w\])]": r"[\p{L}\p{N}_\])]",  # before a parenthesis SQL looks for letters and digits of any script
    r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))",  # the one of Java differs between its versions
    r"\s": r"[\t\n\f\r ]",
    r"\S": r"[^\t\n\f\r ]",
    "(?i)": "(?iu)",
}


def profile(name: str) -> dict[str, list[str]]:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; there are {sorted(PROFILES)}")
    return PROFILES[name]


def in_re2(p: str) -> str:
    """A pattern in Java's dialect that takes what RE2 takes for the given one."""
    # one look is enough beside a letter, but for s and k, whose other forms outside of ASCII match too
    p = re.sub(r"(?i)\\b(?=[a-jl-rt-z0-9](?![?*{]))", r"(?<!\\w)", p)
    p = re.sub(r"(?i)(?<=[a-jl-rt-z0-9])\\b", r"(?!\\w)", p)
    for of_python, of_java in _RE2.items():
        p = p.replace(of_python, of_java)
    return p


def pattern(name: str, family: str, re2: bool = False) -> str:
    """The family's pattern in Java's dialect."""
    alternatives = profile(name)[family]
    if not re2:
        return FLAGS + "|".join(alternatives)
    # neighbours that begin at a boundary look for it once
    parts = [r"\b(?:" + "|".join(p[2:] for p in ps) + ")" if at_boundary else "|".join(ps) for at_boundary, ps in groupby(alternatives, lambda p: p.startswith(r"\b"))]
    return RE2_FLAGS + in_re2("|".join(parts))


def _needed(parsed) -> set[str] | None:
    """Of a parsed pattern: texts of which each match has one, the longest that are found; None if there are none."""
    found: list[set[str]] = []
    run = ""
    for op, arg in [*parsed, (None, None)]:
        if op is parser.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            found.append({run})
        run = ""
        inner = None
        if op is parser.SUBPATTERN:
            inner = _needed(arg[-1])
        elif op is parser.MAX_REPEAT and arg[0] > 0:
            inner = _needed(arg[2])
        elif op is parser.BRANCH:
            each = [_needed(x) for x in arg[1]]
            inner = set().union(*each) if all(each) else None
        if inner:
            found.append(inner)
    return max(found, key=lambda x: min(map(len, x)), default=None)


@cache
def needles(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """Lower-case texts of which every match of any of the patterns has one; none if that can't be said."""
    each = [_needed(parser.parse(p)) for p in patterns]
    if not all(each):
        return ()
    every = set().union(*each)
    return tuple(sorted(x for x in every if not any(y != x and y in x for y in every)))


def coverage(name: str) -> dict[str, int]:
    """Pieces between bars in each family's pattern, those of inner groups included."""
    return {k: "|".join(v).count("|") + 1 for k, v in sorted(profile(name).items())}
