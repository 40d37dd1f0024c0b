"""Patterns, word lists and rule texts of the audit. All values here are fixed: results depend on each of them."""

from __future__ import annotations

import re

#: Java dialect of the patterns: any case, Unicode-aware classes, "." stops at line feeds only.
JAVA = "(?iUd)"
#: The same for DuckDB's engine, where U would mean something else.
DUCK = "(?i)"

# Pattern counts of a file.
INLINE_CSS = r"""style\s*=\s*["'][^"']*["']"""
INTERNAL_STYLE = r"<style\b[^>]*>[\s\S]*?</style>"
EXTERNAL_STYLESHEET = r"""(?:<link\b[^>]*rel\s*=\s*["']stylesheet["'][^>]*>|@import\s+(?:url\()?["'][^"']+["'])"""
INLINE_JS = r"""(?:\bon\w+\s*=\s*["'][^"']*["']|href=["']\s*javascript:)"""
INTERNAL_SCRIPT = r"<script\b(?![^>]*\bsrc=)[^>]*>[\s\S]*?</script>"
ANY_SCRIPT = r"<script\b[^>]*>[\s\S]*?</script>"
SCRIPT_WITH_SRC = r"^<script\b[^>]*\bsrc="
EXTERNAL_SCRIPT = r"""(?:<script\b[^>]*src\s*=\s*["'][^"']+["'][^>]*>|\bimport\s+(?:[\w\s{},*]+from\s+)?["'][^"']+["']|\brequire\s*\(\s*["'][^"']+["']\s*\)|\bdefine\s*\(\s*\[)"""
CSS_IN_JS = r"(?:styled\.\w+|css`|styled\s*\()"

# Network calls, in matching order.
AJAX_PARTS = (
    r"\bfetch\s*\(",
    r"new\s+XMLHttpRequest\s*\(",
    r"(?:\$|jQuery|axios|superagent|http)\s*\.\s*(?:ajax|get|post|getJSON|getScript|load|request|ajaxSetup|ajaxPrefilter|ajaxTransport|param|parseJSON)\s*\(",
    r"\.(?:load|ajaxStart|ajaxSend|ajaxSuccess|ajaxError|ajaxComplete|ajaxStop|serialize|serializeArray)\s*\(",
    r"""\.open\s*\(\s*["'](?:GET|POST|PUT|DELETE|PATCH)["']""",
    r"\bonreadystatechange\s*=",
    r"\.send\s*\(",
    r"\baxios(?:\.\w+)?\s*\(",
    r"new\s+WebSocket\s*\(",
    r"new\s+EventSource\s*\(",
    r"\bajax\s*:\s*function",
    r"navigator\.sendBeacon\s*\(",
    r"new\s+ActiveXObject\s*\(",
    r"\bio\s*\(",
    r"HubConnectionBuilder",
    r"\bSys\.Net\.WebRequest\s*\(",
    r"\bPageMethods\.\w+\s*\(",
    r"\b__doPostBack\s*\(",
    r"\bSys\.WebForms\.PageRequestManager",
    r"\bdata-ajax(?:-\w+)?\s*=",
    r"\.setRequestHeader\s*\(",
    r"\.abort\s*\(",
    r"\.getResponseHeader\s*\(",
    r"\.getAllResponseHeaders\s*\(",
    r"new\s+Headers\s*\(",
    r"new\s+Request\s*\(",
    r"\bJSON\.parse\s*\(",
    r"\bJSON\.stringify\s*\(",
    r"<\w+:UpdatePanel",
    r"<\w+:ScriptManager",
    r"\bScriptManager\.RegisterStartupScript\s*\(",
    r"\bScriptManager\.RegisterClientScriptBlock\s*\(",
    r"\bClientScript\.RegisterStartupScript\s*\(",
    r"\bClientScript\.RegisterClientScriptBlock\s*\(",
    r"\bPage\.ClientScript\s*\.",
    r"\[WebMethod\]",
    r"\[ScriptMethod\]",
    r"\[WebService\]",
    r"\[OperationContract\]",
    r"\[ApiController\]",
    r"""\[Route\(\s*["']api/""",
    r"\[HubName\]",
    r"\bhubConnection\.start\s*\(",
    r"\bClients\.All",
    r"\bClients\.Caller",
    r"@Ajax\.ActionLink",
    r"@Ajax\.BeginForm",
    r"@Url\.Action\s*\(",
    r"@Url\.Content\s*\(",
    r"<system\.web\.extensions>",
    r"<scriptResourceHandler>",
    r"<telerik:RadAjaxManager",
    r"<telerik:RadAjaxPanel",
    r"\bRadAjaxManager\b",
    r"\bASPxCallback",
    r"\$http\b",
    r"\bthis\.http\.get\s*\(",
    r"\bthis\.http\.post\s*\(",
    r"\buseQuery\s*\(",
    r"\buseMutation\s*\(",
    r"\bnew\s+Ajax\.Request\s*\(",
    r"\bnew\s+Request(?:.JSON)?\s*\(",
    r"""\bdataType\s*:\s*["']jsonp["']""",
    r"""\bResponse\.Write\s*\(\s*["']<script""",
    r"\bChannelFactory<",
    r"\bHttpClient\s+",
    r"\bIJSRuntime\b",
    r"\[Http(?:Get|Post|Put|Delete|Patch|Options)\]",
    r"\bbackgroundFetch\b",
    r"""target=["']_?iframe["']""",
    r"""<iframe\b[^>]*style=["'].*display:\s*none""",
    r"\bnew\s+FormData\b",
    r"\bnew\s+Image\s*\(",
    r"""\.src\s*=\s*["']http""",
)
AJAX = "(?:" + "|".join(AJAX_PARTS) + ")"


#: Characters beyond ASCII that fold to a letter where case is ignored.
_FOLDED = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}
_PLAIN = re.compile(r"(?:\\([^\w\s])|([\w<@]))(?![?*+{])")


def _any_case(letters: list[str]) -> str:
    """A class of characters in both cases with what folds to them, for an engine that minds the case."""
    return "[" + "".join(re.escape(x) for c in letters for x in dict.fromkeys((c.lower(), c.upper()))) + "".join(_FOLDED.get(c, "") for c in letters) + "]"


def _beginnings(part: str) -> list[tuple[str, str]]:
    """(first, second) character of what ``part`` matches, in lower case, for each way it may begin; the second may be unknown."""
    bare = part.removeprefix(r"\b")
    ways = [w + bare[bare.index(")") + 1 :] for w in bare[3 : bare.index(")")].split("|")] if bare.startswith("(?:") else [bare]
    out = []
    for w in ways:
        one = _PLAIN.match(w)
        two = _PLAIN.match(w, one.end())
        out.append(((one[1] or one[2]).lower(), (two[1] or two[2]).lower() if two else ""))
    return list(dict.fromkeys(out))


def by_beginning(parts: tuple[str, ...]) -> str:
    """The same alternation, entered by the first two characters, tested by plain classes: parts of one first character keep their order."""
    groups: dict[str, list[str]] = {}
    seconds: dict[str, list[str]] = {}
    for part in parts:
        begins = _beginnings(part)
        for first in dict.fromkeys(a for a, _ in begins):
            groups.setdefault(first, []).append(part)
        for first, second in begins:
            seconds.setdefault(first, []).append(second)
    pair = lambda c: _any_case([c]) + ("" if "" in seconds[c] else _any_case(list(dict.fromkeys(seconds[c]))))
    enter = lambda inner: f"(?-iU:(?={inner}))"
    return enter(_any_case(list(groups))) + "(?:" + "|".join(f"{enter(pair(c))}(?:{'|'.join(own)})" for c, own in groups.items()) + ")"


#: For engines with look-ahead: several times faster on text that doesn't match.
AJAX_FAST = by_beginning(AJAX_PARTS)
#: Texts in lower case, or a plain pattern after "re:", one of which stands inside whatever AJAX matches.
AJAX_NEEDLES = (
    "$", "@", "[", "fetch", "xmlhttprequest", "jquery", "axios", "superagent", "http", ".load", ".ajax", ".serialize", ".open", "onreadystatechange", ".send", "websocket", "eventsource", "ajax", "activexobject", r"re:\bio\s*\(",
    "hubconnection", "sys.", "pagemethods", "__dopostback", ".setrequest", ".abort", ".getresponse", ".getallresponse", "headers", "request", "json", "updatepanel", "scriptmanager", "clientscript", "clients.",
    "<system", "<scriptresource", "<telerik", "aspxcallback", "usequery", "usemutation", "response.write", "channelfactory", "ijsruntime", "backgroundfetch", "iframe", "formdata", "image", ".src",
)
#: Pieces of a text, cut so that no match lies in more than two of them; a match of the part with IFRAME alone may.
AJAX_PIECE = r"(?s).{400,}?(?:(?<=[;{}])|(?=<))|.+"
IFRAME = "<iframe"

# Code made at run time.
DYNAMIC_JS_PARTS = (
    r"""\.src\s*=\s*["'][^"']+\.js["']""",
    r"""document\.createElement\s*\(\s*["']script["']\s*\)""",
    r"\.appendChild\s*\(",
    r"\.insertBefore\s*\(",
    r"eval\s*\(",
    r"new\s+Function\s*\(",
    r"setTimeout\s*\(",
    r"setInterval\s*\(",
    r"import\s*\(",
    r"System\.import\s*\(",
    r"require\s*\(",
    r"innerHTML\s*=",
    r"outerHTML\s*=",
    r"insertAdjacentHTML\s*\(",
    r"document\.write\s*\(",
)
DYNAMIC_CSS_PARTS = (
    r"""\.src\s*=\s*["'][^"']+\.css["']""",
    r"""document\.createElement\s*\(\s*["']style["']\s*\)""",
    r"""document\.createElement\s*\(\s*["']link["']\s*\)""",
    r"""\.rel\s*=\s*["']stylesheet["']""",
    r"""\.href\s*=\s*["'][^"']+\.css["']""",
    r"\.style\.\w+\s*=",
    r"""\.style\[\s*["'][^"']+["']\s*\]\s*=""",
    r"\.cssText\s*=",
    r"setProperty\s*\(",
    r"insertRule\s*\(",
    r"addRule\s*\(",
    r"""setAttribute\s*\(\s*["']style["']""",
    r"\.classList\.(?:add|remove|toggle|replace)\s*\(",
    r"new\s+CSSStyleSheet\s*\(",
    r"adoptedStyleSheets",
)
DYNAMIC_JS = "(?:" + "|".join(DYNAMIC_JS_PARTS) + ")"
DYNAMIC_CSS = "(?:" + "|".join(DYNAMIC_CSS_PARTS) + ")"

# Groups of dynamic code in a finding, in the order in which the first one counts.
DYNAMIC_GROUPS = (
    ("dom_sink", r"\.(?:innerHTML|outerHTML|insertAdjacentHTML|write|writeln)\s*="),
    ("js_sink", r"\b(?:eval|new\s+Function|setTimeout|setInterval|import|System\.import)\s*\("),
    ("dynamic_load", r"""\.(?:src|href)\s*=\s*|document\.createElement\s*\(\s*["'](?:script|style|link)["']\s*\)"""),
    (
        "dynamic_css",
        r"""(?:\.style\.\w+\s*=|.style\[\s*["'][^"']+["']\s*\]\s*=|.cssText\s*=|setProperty\s*\(|insertRule\s*\(|addRule\s*\(|setAttribute\s*\(\s*["']style["']|.classList\.(?:add|remove|toggle|replace)\s*\(|new\s+CSSStyleSheet\s*\(|adoptedStyleSheets)""",
    ),
    ("css_in_js", CSS_IN_JS),
)

# What ties code to the server.
SERVER_DEPENDENCIES = (r"@Model\.", r"@ViewBag\.", r"@ViewData\.", r"@Url\.Action", r"@Url\.Content", r"<%=", r"<%:", r"<%\s", r"\{\{.*?\}\}", r"\bResponse\.Write\b", r"\bRequest\.Form\b")
SEVERITY_HIGH = r"@Model\.|<%\s"
SEVERITY_MEDIUM = r"@Url\.|@ViewBag\.|@ViewData\."
SEVERITY_LOW = r"<%=|@DateTime\."

# Endpoints.
URL_PROPERTY = r"""url\s*:\s*['"]([^'"]+)['"]"""
URL_CONCAT = r"""url\s*:\s*([a-zA-Z_$][a-zA-Z0-9_$]*\s*\+\s*['"][^'"]+['"])"""
URL_TEMPLATE = r"url\s*:\s*`([^`]+)`"
URL_VARIABLE = r"url\s*:\s*([a-zA-Z_$][a-zA-Z0-9_$]*)(?:\s|,|\))"
FETCH_LITERAL = r"""fetch\s*\(\s*['"]([^'"]+)['"]"""
FETCH_TEMPLATE = r"fetch\s*\(\s*`([^`]+)`"
JQUERY_LITERAL = r"""\$\.(?:get|post|getJSON|load)\s*\(\s*['"]([^'"]+)['"]"""
AXIOS_LITERAL = r"""axios\.(?:get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""

# Logic density, on lower-cased code.
LOGIC = r"\bfunction\s+\w+|\bif\s*\(|\bfor\s*\(|\bwhile\s*\("
LISTENERS = r"\.addeventlistener"
SELECTORS = r"""document\.getelementbyid|document\.queryselector|\$\(["']"""

# Words that give a finding's functionality, first match wins.
FUNCTIONALITY = (
    ("Form Validation", ("validate", "regex", "return false")),
    ("UI Interaction", ("click", "hover", "on(")),
    ("Data Visualization", ("chart", "graph")),
    ("Visual Effects", ("style", "class", "show()", "hide()")),
)

# Server-side template syntax in extracted blocks.
RAZOR_CONTROL = (r"@if\s*\(", r"@else", r"@foreach\s*\(", r"@for\s*\(", r"@while\s*\(", r"@switch\s*\(", r"@using\s*\(", r"<%\s*if", r"<%\s*for", r"<%\s*while")
RAZOR_VALUES = (r"@Url\.Action\([^)]+\)", r"@Url\.Content\([^)]+\)", r"@Model\.\w+", r"@ViewBag\.\w+", r"@ViewData\[[^\]]+\]", r"@Html\.\w+", r"<%=\s*[^%]+%>")
SIMPLE_AJAX = (r"\$\.ajax\s*\(", r"\$\.get\s*\(", r"\$\.post\s*\(", r"\.ajax\s*\(", r"fetch\s*\(", r"XMLHttpRequest\s*\(", r"\$http\.", r"axios\.")
EXTRACTED_NAME = r"^(.+)_([a-zA-Z0-9]+)_line(\d+)-(\d+)\.(js|css)$"

# File kinds and folders.
INCLUDE_EXTENSIONS = (".aspx", ".ascx", ".master", ".html", ".htm", ".cshtml", ".vbhtml", ".js", ".ts", ".vue", ".jsx", ".tsx", ".php", ".jsp")
WEB_EXTENSIONS = (".html", ".htm", ".aspx", ".ascx", ".cshtml", ".vbhtml", ".master", ".php", ".jsp", ".js", ".ts", ".vue", ".jsx", ".tsx", ".razor", ".cs", ".vb", ".ashx", ".asmx", ".config")
PAGE_EXTENSIONS = (".html", ".htm", ".aspx", ".cshtml", ".php", ".jsp")
RECOUNT_EXTENSIONS = (".html", ".htm", ".aspx", ".ascx", ".cshtml", ".master", ".php", ".jsp", ".js", ".ts", ".vue", ".jsx", ".tsx")
SKIP_LINK_EXTENSIONS = (".css", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".ttf", ".pdf")
STATIC_EXCLUDED_FOLDERS = ("bin", "obj", "packages", "node_modules", ".git", ".vs", ".idea", "App_Data")
DEPTH_EXCLUDED_FOLDERS = ("node_modules", "vendor", "packages", ".git", ".svn", ".hg", "bin", "obj", "dist", "build", "out", "target", "__pycache__", ".pytest_cache", ".venv", "venv", "env")
LARGE_FILE_BYTES = 10 * 1024 * 1024
MAX_DEPTH = 5

# Attributes that hold event handlers.
EVENT_HANDLERS = (
    "onclick", "ondblclick", "onmousedown", "onmouseup", "onmouseover", "onmousemove", "onmouseout", "onmouseenter", "onmouseleave", "oncontextmenu",
    "onkeydown", "onkeypress", "onkeyup",
    "onsubmit", "onreset", "onchange", "oninput", "onfocus", "onblur", "onselect",
    "onload", "onunload", "onbeforeunload", "onresize", "onscroll",
    "onerror", "onabort", "onplay", "onpause", "onvolumechange", "ontimeupdate",
    "ondrag", "ondragstart", "ondragend", "ondrop",
)
REFACTORED_EVENTS = ("onclick", "onload", "onmouseover", "onsubmit")

# Classification of a match by its lower-cased text, first rule wins:
# (texts, any of which it contains; text that it must not contain; capability; category; counted; difficulty; static profile: other difficulty or counted).
AJAX_RULES = (
    (("sendbeacon",), "", "Telemetry", "Request", True, "Easy", {}),
    (("getscript", ".js"), "", "Script Loading (Dynamic)", "Request", True, "Hard", {}),
    ((".css",), "", "CSS Loading", "Request", True, "Medium", {}),
    ((".html",), "", "UI Injection", "Request", True, "Medium", {}),
    (("load",), "payload", "UI Injection (Likely)", "Request", True, "Medium", {}),
    (("ajaxsetup", "ajaxprefilter", "ajaxtransport"), "", "AJAX Configuration", "Config", False, "Easy", {}),
    (("ajaxstart", "ajaxsend", "ajaxsuccess", "ajaxerror", "ajaxcomplete", "ajaxstop", "onreadystatechange"), "", "Global Event Handler", "Event", False, "Hard (Refactoring Risk)", {}),
    (("serialize", "param", "parsejson"), "", "Form/Data Utility", "Utility", False, "Easy", {}),
    (("sys.net.webrequest",), "", "Data Exchange (Legacy)", "Request", True, "Hard", {}),
    (("pagemethods",), "", "RPC (Code-Behind)", "Request", True, "Hard", {}),
    (("__dopostback",), "", "Partial Postback", "Request", True, "Medium", {}),
    (("data-ajax",), "", "Declarative AJAX", "Request", True, "Easy", {}),
    (("sys.webforms",), "", "UpdatePanel Config", "Config", False, "Hard", {}),
    (("setrequestheader", "getresponseheader", "getallresponseheaders"), "", "Request Header Manipulation", "Config", False, "Medium", {}),
    (("abort",), "", "Request Control", "Utility", False, "Easy", {}),
    (("json.parse", "json.stringify"), "", "JSON Utility", "Utility", False, "Easy", {}),
    (("new headers", "new request"), "", "Fetch API Construct", "Construct", False, "Easy", {}),
    (("updatepanel",), "", "Partial Rendering (UpdatePanel)", "Request", True, "Hard", {}),
    (("scriptmanager", "clientscript"), "", "Server-Side Script Injection", "Server", False, "Hard", {}),
    (("webmethod", "scriptmethod", "webservice"), "", "AJAX Endpoint (Server)", "Server", False, "Medium", {}),
    (("apicontroller", "[route"), "", "API Endpoint (Server)", "Server", False, "Medium", {}),
    (("operationcontract",), "", "WCF Endpoint (Server)", "Server", False, "Hard", {}),
    (("hubname", "clients.all", "clients.caller"), "", "SignalR Hub (Server)", "Server", False, "Hard", {}),
    (("hubconnection",), "", "SignalR Client", "Real-time", True, "Medium", {"difficulty": "Easy"}),
    (("@ajax",), "", "Razor AJAX Helper", "Request", True, "Medium", {"difficulty": "Easy"}),
    (("@url",), "", "Dynamic URL Generation", "Construct", False, "Easy", {}),
    (("<system.web.extensions>", "scriptresourcehandler"), "", "AJAX Configuration", "Config", False, "Medium", {}),
    (("radajax", "telerik"), "", "Telerik AJAX Control", "Third-Party", True, "Hard (Vendor Lock-in)", {}),
    (("aspxcallback",), "", "DevExpress AJAX Control", "Third-Party", True, "Hard (Vendor Lock-in)", {}),
    (("response.write",), "", "Direct Script Injection", "Server", False, "High (Security Risk)", {}),
    (("channelfactory",), "", "WCF Client Proxy", "Server", True, "Hard", {}),
    (("httpclient",), "", ".NET HttpClient", "Server/Blazor", True, "Easy", {}),
    (("ijsruntime",), "", "Blazor JS Interop", "Blazor", False, "Medium", {}),
    (("[http",), "", "API Endpoint Verb", "Server", False, "Easy", {}),
    (("backgroundfetch",), "", "Background Sync/Fetch", "Service Worker", True, "Medium", {}),
    (("iframe",), "", "Hidden Iframe (Pseudo-AJAX)", "Legacy Pattern", True, "Hard", {}),
    (("formdata",), "", "Form Data Construction", "Construct", False, "Easy", {}),
    (("new image", ".src"), "", "Pixel Tracking (Image)", "Request", True, "Easy", {}),
    (("usequery", "usemutation"), "", "Modern Data Fetching (React Query)", "Modern Framework", True, "Easy", {}),
    (("this.http",), "", "Angular HttpClient", "Modern Framework", True, "Easy", {}),
    (("ajax.request",), "", "Prototype.js AJAX", "Legacy Lib", True, "Hard", {}),
    (("jsonp",), "", "JSONP (Legacy Cross-Domain)", "Legacy Pattern", True, "Hard (Security Risk)", {}),
    (("new xmlhttprequest",), "", "XHR Construct", "Construct", False, "Easy", {}),
    ((".open",), "", "XHR Construct", "Construct", False, "Easy", {"counted": True}),
    (("new websocket", "new eventsource"), "", "Real-time Construct", "Construct", True, "Easy", {"skip": True}),
)
AJAX_DEFAULT = ("Data Exchange", "Request", True, "Easy")
UNKNOWN_ENDPOINTS = ("Dynamic/Variable", "Server-Generated", "Unknown/Dynamic")
NOT_DOMAINS = ("Manual Review Required", "Self", "Self (Assumed)")
