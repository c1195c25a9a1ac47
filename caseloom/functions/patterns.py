"""Patterns, word lists and tokens that results depend on."""

LEGAL = (
    r"(?i)\b(pursuant|herein|thereof|whereas|notwithstanding|shall|hereby|compliance|regulation|statute"
    r"|provision|amendment|section\s+\d|article\s+\d|subsection|paragraph|clause|stipulate|obligation)\b"
)
INFORMAL = (
    r"(?i)\b(hi|hey|hello|thanks|cheers|btw|fyi|asap|lol|ok|okay|sure|let me know|sounds good|no worries"
    r"|got it)\b"
)
HEADER_NAMES = "From|To|Cc|Bcc|Subject|Date|Sent|Received|Message-ID|In-Reply-To|References"
HEADER_LINE = rf"(?im)^({HEADER_NAMES}):\s*.+"
UPPER_HEADING = "^[A-Z][A-Z\\s,&:;–—-]{4,}$"
UPPER_HEADING_DIGITS = "^[A-Z][A-Z0-9\\s,&:;–—-]{4,}$"
SIGNATURE = (
    r"(?i)^(--|___+|---+|\*\*\*+|~~+|Best\s+regards|Kind\s+regards|Regards|Sincerely|Thanks|Thank\s+you"
    r"|Cheers|Sent\s+from)"
)
WROTE = r"(?im)^On\s+.{10,80}\s+wrote:\s*$"
LIST_LINE = r"(?i)^(\s*[\-\*•]\s+|\s*\d+[\.\)]\s+|\s*[a-z][\.\)]\s+|\s*[ivxlcdm]+[\.\)]\s+)"
TABLE_BLOCK = r"(?s)\[TABLE\].*?\[/TABLE\]"
CITATION = r"(?i)\[Source:\s*([^\],]+?)(?:\s*,\s*p\.?\s*(\d+))?\]"
TOKEN = r"[\p{L}\p{N}_]{3,}"
MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
DATE_MENTION = rf"\b\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}\b|\b{MONTH}\w*\s+\d{{1,2}},?\s*\d{{4}}\b"
CRITICAL = (
    r"(?i)(?:\$[\d,]+(?:\.\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?%|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
    rf"|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}|{MONTH}\w*\s+\d{{1,2}},?\s*\d{{2,4}}|\d{{1,2}}\s+{MONTH}\w*\s+\d{{2,4}})"
)
PII = [
    # type, pattern, token
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"),
    ("PHONE", r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b", "[PHONE_REDACTED]"),
    ("SSN", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[SSN_REDACTED]"),
    (
        "CREDIT_CARD",
        r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
        "[CREDIT_CARD_REDACTED]",
    ),
    (
        "IP_ADDRESS",
        r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
        "[IP_REDACTED]",
    ),
    (
        "DATE_OF_BIRTH",
        r"(?i)\b(?:DOB|Date\s+of\s+Birth|Born)[:.\s]*"
        r"(?:\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2})\b",
        "[DOB_REDACTED]",
    ),
    ("BANK_ACCOUNT", r"(?i)\b(?:Account\s*(?:No|Number|#)?[:.\s]*)\d{8,17}\b", "[BANK_ACCOUNT_REDACTED]"),
    ("ROUTING_NUMBER", r"(?i)\b(?:Routing\s*(?:No|Number|#)?[:.\s]*)\d{9}\b", "[ROUTING_NUMBER_REDACTED]"),
    ("PASSPORT", r"(?i)\b(?:Passport\s*(?:No|Number|#)?[:.\s]*)[A-Z0-9]{6,9}\b", "[PASSPORT_REDACTED]"),
    (
        "DRIVERS_LICENSE",
        r"(?i)\b(?:DL|Driver'?s?\s+License\s*(?:No|Number|#)?[:.\s]*)[A-Z0-9]{5,15}\b",
        "[DRIVERS_LICENSE_REDACTED]",
    ),
]
TIMELINE = (
    "timeline|chronolog|sequence|when did|what happened|history of|events|between.*and|from.*to.*date"
)
COMPARISON = "compare|difference|versus| vs |contrast|how does.*differ|similarities"
SUMMARY = "summarize|summary|overview|key findings|main points|what are the|describe"
FACT = (
    "how much|how many|what is the|what was the|who is|who was|who signed|what date|what amount"
    "|what percentage"
)
