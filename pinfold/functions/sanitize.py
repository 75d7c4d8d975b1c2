"""Removal of what a reader doesn't see, and detection of text that addresses an agent."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from pinfold.session import ship_active

# What counts as hidden, in the order in which it is removed.
COMMENT = r"(?s)<!--.*?-->"
HIDDEN = (
    r"(?is)<(script|style|template|noscript)\b.*?</(script|style|template|noscript)\s*>"
    r"|<[a-z][a-z0-9]*\b[^>]*(\bhidden\b|display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0)[^>]*>.*?</[a-z][a-z0-9]*\s*>"
)
HIDDEN_REF = r"(?m)^\s*\[(//|comment|_)\]:\s*#.*$"
# Fixed value: bytes of an item that are kept.
MOST_BYTES = 256 << 10

# Patterns of text that addresses an agent or smuggles actions; any match makes a text suspect.
SUSPECT = [
    # instruction override
    r"(?i)\b(ignore|disregard|forget|override|bypass)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all|your|system|everything|anything)\b[^.\n]{0,20}\b(instructions?|prompts?|rules|messages?|context|guidance|above|before)\b",
    r"(?i)\b(previous|prior|earlier|above)\s+(context|prompts?|messages)\b[^.\n]{0,30}\b(outdated|obsolete|void|invalid|cancel+ed)\b",
    r"(?i)\b(follow|obey)\s+only\s+(the\s+)?(instructions?|rules)\b|\bnew\s+(instructions?|rules)\b[^.\n]{0,20}\b(override|replace|supersede)",
    r"(?i)\b(set aside|put aside|drop|discard|forget)\b[^.\n]{0,30}\b(guidance|instructions?|rules|what you (were|have been) (told|given))\b[^.\n]{0,40}\b(earlier|before|previously|above|instead|follow)\b",
    r"(?i)\b(the\s+)?real\s+instructions\s+(follow|are below|start here)\b",
    # role hijack
    r"(?i)\b(you are|you're|act as|pretend to be|from now on,? you)\b[^.\n]{0,30}\b(an? )?(ai|assistant|agent|llm|language model|claude|gpt|copilot)\b",
    r"(?i)\b(act as|pretend to be|you are now|roleplay as)\b[^.\n]{0,20}\b(an? |the )?(system administrator|sysadmin|admin(istrator)?|root|superuser|developer mode|repository owner|owner|maintainer|unrestricted|jailbroken)\b",
    r"(?i)\bas an ai( language model)?\b[^.\n]{0,30}\b(you|must|required|should)\b",
    r"(?i)\b(act as|pretend to be|you are now|operating as)\b[^.\n]{0,25}\b(mentor|owner|maintainer|admin(istrator)?|lead|captain|root|superuser|developer|reviewer|moderator)\b[^.\n]{0,25}\b(and|then|to)\b[^.\n]{0,20}\b(merge|approve|push|delete|run|execute|install|publish|release)\b",
    r"(?i)\b(you're|you are)\s+(now\s+)?(operating|running|working)\s+in\s+[a-z]+\s+mode\b",
    # addressing the agent
    r"(?i)(^|[.!?]\s+|\n)\s*(dear |hey |hi |hello |attention,? )?(claude|chatgpt|gpt-?\d?|copilot|gemini|cursor|codex|llm|ai|assistant)\s*[,:]",
    r"(?i)\b(note|message|instructions?|attention|reminder)\s+(to|for)\s+(the\s+|any\s+|all\s+)?(ai|llm|assistant|agent|model|claude|gpt|copilot)s?\b",
    r"(?i)\b(if you are|if you're)\s+an?\s+(ai|llm|assistant|agent|language model|bot)\b",
    r"(?i)(^|[.!?]\s+|\n)\s*(for\s+)?(automated|machine|ai|llm)\s+(readers?|agents?|assistants?|eyes)(\s+only)?\s*[:,]|\bfor\s+(automated|machine|ai|llm)\s+(readers?|agents?|assistants?|eyes)\b|\b(hidden|secret)\s+(instruction|prompt|message)s?\b",
    r"(?i)\bto\s+the\s+(ai|llm|model|assistant|agent|bot)\s+(reading|processing|parsing|summari[sz]ing)\b",
    r"(?i)\b(?:(?:ai|llm|coding|automated)\s+(?:assistants?|agents?|models?|tools?)|llms?)\b[^.\n]{0,20}\b(must|should|need to|needs to|have to|has to|are required to)\b[^.\n]{0,60}\b(run|execute|delete|remove|send|upload|post|curl|install|commit|push|approve|import|add|disable)\b",
    r"(?i)\b(an?|the|any)\s+(ai|llm)\b[^.\n]{0,60}\b(must|should|needs? to|is required to)\b[^.\n]{0,40}\b(run|execute|install|delete|remove|send|upload|commit|push|approve|import|add)\b",
    # covert action and forged authority
    r"(?i)\b(do not|don't|never)\s+(tell|inform|show|mention|reveal|notify)\b[^.\n]{0,25}\b(the\s+)?user\b|\bsilently\s+(run|execute|install|delete|remove|commit|push|send|upload|approve)\b",
    r"(?i)\b(run|execute|install|delete|remove|commit|push|approve|merge|upload)\b[^.\n]{0,40}\bwithout\s+(asking|telling|showing|confirmation|confirming|notifying)\b",
    r"(?i)\bskip\s+(the\s+)?(confirmation|approval|permission)\b[^.\n]{0,40}\b(run|execute|install|delete|push|merge|approve)\b|\bthe\s+user\s+(already|has already)\s+(agreed|approved|consented)\b",
    r"(?i)\b(you have|you've been (given|granted)|you are (granted|allowed|authori[sz]ed)|the user has (authori[sz]ed|allowed|approved|granted))\b[^.\n]{0,30}\b(permission|authori[sz]ation|approval|access|you)\b[^.\n]{0,30}\b(to|for)\b[^.\n]{0,20}\b(modify|write|delete|push|execute|run|bypass|approve|files? outside|merge)",
    r"(?i)\b(tool\s+)?confirmations?\s+(is|are)\s+(disabled|not required|off|skipped)\b|\b(system|admin|developer|god)\s+(override|mode)\s*[:!]",
    r"(?i)(^|\n)\s*(!!!|\?\?\?)?\s*(system\s+override|developer\s+mode)\b",
    # forged conversation or tool markup
    r"(?i)\bsystem\s*prompt\b|<\s*/?\s*(system|assistant|tool_call|tool_result|function_calls?|invoke)(\s+[a-z_]+\s*=[^>]*)?\s*>|\[/?INST\]|<\|(im_start|im_end|system|assistant|user)\|>",
    r"(?im)^\s*#{1,6}\s*(system|assistant)\s*:|\[(system|assistant)\]\s*:?",
    r'(?i)"(tool|name)"\s*:\s*"[a-z_]+"\s*,\s*"(arguments|input|parameters)"\s*:',
    # remote code execution
    r"(?i)\b(curl|wget|iwr|invoke-webrequest|irm|invoke-restmethod)\b[^|\n]{0,200}\|\s*(sudo\s+)?((ba|z|fi|da|k)?sh|python\d?(\.\d+)?|perl|ruby|node|iex|pwsh|powershell)\b|\biex\s*\(|\b(ba|z)?sh\s+<\(\s*(curl|wget)",
    r"(?i)\b(decode|decoding|base64\s+-d|from\s+hex|unhex|atob)\b[^.\n]{0,40}\b(execute|run|eval)\b|\b(execute|run|eval)\b[^.\n]{0,30}\b(after\s+)?decod",
    # credentials
    r"(?i)\b(exfiltrate|api[_ -]?keys?|secret[_ -]?keys?|access[_ -]?tokens?|passwords?|private[_ -]?keys?|credentials)\b[^.\n]{0,60}\b(send|post|upload|paste|share|print|echo|email|include|leak)\b|\b(send|(?-i:[Pp]ost)|upload|paste|share|email|leak)\b[^.\n]{0,30}\b(api[_ -]?keys?|secret[_ -]?keys?|access[_ -]?tokens?|passwords?|private[_ -]?keys?|credentials)\b",
    r"(?i)(~/\.ssh/|\bid_(rsa|ed25519|ecdsa)\b|\.aws/credentials|~/\.netrc|\$?\bGITHUB_TOKEN\b|\$?\bAWS_SECRET_ACCESS_KEY\b)",
    # directives to a code generator
    r"(?i)\b(when|whenever)\s+(you\s+)?(generat|writ|produc)\w*\b[^.\n]{0,30}\bcode\b[^.\n]{0,30}\b(always|also must|must also|you must)\b|\b(all|any|every)\s+(code|answers?|responses?|output)\s+(generated|written|produced)\b[^.\n]{0,40}\bmust\b",
    # the override family in other languages
    r"(?i)önceki\s+(tüm\s+)?talimatları\s+(yok\s+say|görmezden\s+gel|unut)|ignora\s+(todas\s+)?las\s+instrucciones\s+(anteriores|previas)|ignoriere\s+(alle\s+)?(vorherigen|bisherigen)\s+anweisungen|ignore[zr]?\s+(toutes\s+)?les\s+instructions\s+(précédentes|antérieures)|ignore\s+(todas\s+)?as\s+instruções\s+anteriores|忽略(之前|以上|先前)的(所有)?(指令|说明)",
]


#: For each pattern the words of which a text must hold one for it to match; looking for them is far cheaper.
TRIGGERS = [
    ("ignore", "disregard", "forget", "override", "bypass"),
    ("outdated", "obsolete", "void", "invalid", "cancel"),
    ("only", "override", "replace", "supersede"),
    ("set aside", "put aside", "drop", "discard", "forget"),
    ("real",),
    ("you are", "you're", "act as", "pretend to be", "from now on"),
    ("act as", "pretend to be", "you are now", "roleplay as"),
    ("as an ai",),
    ("act as", "pretend to be", "you are now", "operating as"),
    ("mode",),
    ("claude", "gpt", "copilot", "gemini", "cursor", "codex", "llm", "ai", "assistant"),
    ("note", "message", "instruction", "attention", "reminder"),
    ("if you are", "if you're"),
    ("reader", "agent", "assistant", "eyes", "instruction", "prompt", "message"),
    ("reading", "processing", "parsing", "summari"),
    ("assistant", "agent", "model", "tool", "llm"),
    ("must", "should", "need", "required"),
    ("user", "silently"),
    ("without",),
    ("skip", "user"),
    ("you have", "you've been", "you are", "the user has"),
    ("confirmation", "override", "mode"),
    ("override", "developer"),
    ("prompt", "<", "["),
    ("system", "assistant"),
    ('"tool"', '"name"'),
    ("curl", "wget", "iwr", "invoke-", "irm", "iex"),
    ("decod", "base64", "hex", "atob"),
    ("exfiltrate", "key", "token", "password", "credential"),
    ("ssh", "id_", "aws", "netrc", "token"),
    ("generat", "writ", "produc"),
    ("önceki", "ignora", "ignoriere", "ignore", "ignorez", "ignorer", "忽略"),
]


def _composed(x: str | None) -> str | None:
    return x if x is None or x.isascii() else unicodedata.normalize("NFC", x)


def _capped(x: str | None) -> str | None:
    x = _composed(x)
    return x if x is None or 4 * len(x) <= MOST_BYTES else x.encode()[:MOST_BYTES].decode("utf-8", "ignore")


def _vectorized(f: Callable[[str | None], str | None]) -> Callable[[pd.Series], pd.Series]:
    ship_active()

    def each(s: pd.Series) -> pd.Series:
        return s.map(f)

    return each


def visible(c: Column) -> Column:
    """Without comments, hidden elements and references, and control or format characters but line breaks and tabs."""
    for pattern in (COMMENT, HIDDEN, HIDDEN_REF):
        c = F.regexp_replace(c, pattern, "")
    return F.regexp_replace(c, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")


def nfc(c: Column) -> Column:
    """Composed form; Spark has no expression for it, so it is one vectorized call."""
    return F.pandas_udf(_vectorized(_composed), T.StringType())(c)


def clean(c: Column) -> Column:
    """visible, composed, and at most MOST_BYTES bytes of it; composing and cutting are one pass."""
    return F.pandas_udf(_vectorized(_capped), T.StringType())(visible(c))


def suspect(c: Column) -> Column:
    """Whether any pattern matches, letters of every script in any case; false for null. A pattern is tried only where one
    of its words occurs."""
    low, out = F.lower(c), F.lit(False)
    for pattern, words in zip(SUSPECT, TRIGGERS, strict=True):
        some = low.contains(words[0])
        for w in words[1:]:
            some = some | low.contains(w)
        out = out | (some & c.rlike(pattern.replace("(?i", "(?iu", 1)))  # else only a-z is read in any case
    return F.coalesce(out, F.lit(False))
