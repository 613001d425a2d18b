"""Code that a tester may run in a browser to check a finding: it reads, or observes, or stops behind a guard.

Every text is shown only if ``safe_to_show`` lets it pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.requests import fill_placeholders, is_base_variable, safe_to_show, strip_base_variable, test_payload
from siftmill.functions.text import bind

GUARD = "  const CONFIRM_AUTHORIZED_TEST = false;\n  if (!CONFIRM_AUTHORIZED_TEST) throw new Error('set CONFIRM_AUTHORIZED_TEST in an authorized test only');\n"
LISTING = "console.table([...document.querySelectorAll('[disabled]')].map((el) => ({ tag: el.tagName, text: el.innerText || el.value })));"


def shown(code: Column) -> Column:
    """The code, or null if it may not be shown."""
    return bind(code, lambda c: F.when(F.coalesce(safe_to_show(c), F.lit(False)), c))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return bind(F.to_json(F.array(text)), lambda j: F.substr(j, F.lit(2), F.length(j) - 2))


def _target(endpoint: Column) -> Column:
    """Lines that declare the address; a base variable has to be filled in by hand."""
    based = F.concat(F.lit("  const API_BASE = 'https://TARGET';\n  const target = API_BASE + "), quoted(strip_base_variable(endpoint)), F.lit(";\n"))
    return F.when(is_base_variable(endpoint), based).otherwise(F.concat(F.lit("  const target = "), quoted(fill_placeholders(endpoint)), F.lit(";\n")))


def disabled_listing() -> Column:
    """Lists disabled controls."""
    return shown(F.lit(LISTING))


def read_request(endpoint: Column) -> Column:
    """One GET request of which status and body are shown."""
    return shown(F.concat(F.lit("(async () => {\n"), _target(endpoint), F.lit("  const answer = await fetch(target, { method: 'GET', credentials: 'include' });\n  console.log(target, answer.status, await answer.text());\n})();")))


def guarded_request(method: Column, endpoint: Column, names: Column) -> Column:
    """One changing request with harmless test values, behind a guard that is off."""
    send = F.concat(F.lit("  const answer = await fetch(target, { method: '"), F.upper(method), F.lit("', credentials: 'include', headers: { 'Content-Type': 'application/json' }, body: JSON.stringify(payload) });\n  console.log(target, answer.status, await answer.text());\n})();"))
    return shown(F.concat(F.lit("(async () => {\n" + GUARD), _target(endpoint), F.lit("  const payload = "), F.to_json(test_payload(names)), F.lit(";\n"), send))


def request_observer(endpoint: Column) -> Column:
    """Stops in the debugger when the page itself calls the address; null without a known one."""
    code = F.concat(F.lit("(() => {\n" + GUARD + "  const target = "), quoted(endpoint), F.lit(";\n  const original = window.fetch;\n  window.fetch = function (input, init) {\n    if (String(input).includes(target)) { console.log(init && init.body); debugger; }\n    return original.call(this, input, init);\n  };\n})();"))
    return F.when(endpoint != "UNKNOWN", shown(code))
