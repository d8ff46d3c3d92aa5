"""Classification of provider errors, by class and message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hints that a rate limit is one of the day, and marks of transient embedding errors.
DAILY_HINTS = ("per day", "/day", "daily", "rpd", "requests per day", "quota", "exhausted", "insufficient_quota", "billing", "free tier", "credit", "out of", "limit reached for the day")
TRANSIENT_HINTS = ("resource_exhausted", "rate limit", "rate-limit", "ratelimit", "quota", "too many requests", "unavailable", "overloaded", "deadline", "timeout", "try again")
TRANSIENT_CODES = (429, 500, 502, 503, 504)
DAY, MINUTE, NETWORK, PROVIDER = 86_400.0, 60.0, 3.0, 5.0

#: (error classes, hints in the message or none, action, seconds to wait, tell the admin, permanent): the first that holds counts.
RULES = (
    (("ContextWindowExceededError",), (), "skip_request", None, True, False),
    (("ContentPolicyViolationError",), (), "skip_request", None, False, False),
    (("AuthenticationError", "PermissionDeniedError", "BudgetExceededError", "NotFoundError"), (), "disable_key", None, True, True),
    (("RateLimitError",), DAILY_HINTS, "disable_key", DAY, False, True),
    (("RateLimitError",), (), "cooldown_key", MINUTE, False, False),
    (("Timeout", "APIConnectionError"), (), "retry_same", NETWORK, False, False),
    (("ServiceUnavailableError", "InternalServerError"), (), "rotate_key", PROVIDER, False, False),
    (("BadRequestError", "UnprocessableEntityError"), (), "abort_admin", None, True, True),
    ((), ("invalid api key", "api key not valid", "unauthorized", "authentication", "401"), "disable_key", None, True, True),
    ((), ("model not found", "not found", "404", "unknown model", "model does not exist"), "disable_key", None, True, True),
    ((), ("bad request", "invalid request", "invalid argument", "400"), "abort_admin", None, True, True),
    (("APIError",), (), "rotate_key", PROVIDER, False, False),
    ((), (), "skip_request", None, True, False),
)


def any_of(text: Column, hints: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in hints])


def verdict(kind: Column, message: Column) -> Column:
    """struct(action, retry_after, notify_admin, permanent) of an error of class `kind`."""
    text, out = F.lower(F.coalesce(message, F.lit(""))), None
    for kinds, hints, action, wait, notify, permanent in RULES:
        holds = F.lit(True)
        if kinds:
            holds = F.coalesce(kind.isin(*kinds), F.lit(False))
        if hints:
            holds = holds & any_of(text, hints)
        told = F.struct(F.lit(action).alias("action"), F.lit(wait).cast("double").alias("retry_after"), F.lit(notify).alias("notify_admin"), F.lit(permanent).alias("permanent"))
        out = F.when(holds, told) if out is None else out.when(holds, told)
    return out


def transient(code: Column, message: Column, dimension_mismatch: Column) -> Column:
    """True for embedding errors that are worth another try."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return ~F.coalesce(dimension_mismatch, F.lit(False)) & (F.coalesce(code.isin(*TRANSIENT_CODES), F.lit(False)) | any_of(text, tuple(map(str, TRANSIENT_CODES)) + TRANSIENT_HINTS))


def model_name(name: Column) -> Column:
    """Without slashes at the front and without the prefixes models/ and gemini/, each once."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^/+", ""), "^(models/)?(gemini/)?", "")


def provider_model(provider: Column, name: Column) -> Column:
    """provider/name, with the provider once; the bare name where there is no provider."""
    code = F.btrim(F.trim(F.coalesce(provider, F.lit(""))), F.lit("/"))
    clean = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^/+", "")
    return F.when((code == "") | (clean == "") | F.startswith(clean, F.concat(code, F.lit("/"))), clean).otherwise(F.concat(code, F.lit("/"), clean))
