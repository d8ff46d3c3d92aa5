"""Providers, keys, profiles and pools: eligibility, selection, checks of references, and use over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_secret
from ..schema import pool_scope

DEFAULT_TOP_K = 5


def flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def usable_keys(keys: DataFrame, providers: DataFrame, capability: str) -> DataFrame:
    """keys whose provider is enabled and not locked, that are so themselves, and that allow the capability (an empty list allows all)."""
    p = providers.where(flag("is_enabled") & ~flag("is_locked")).select(F.col("id").alias("provider_id"), F.col("code").alias("provider_code"))
    allowed = F.coalesce(F.transform("capabilities", lambda c: F.lower(c)), F.array().cast("array<string>"))
    ok = flag("is_enabled") & ~flag("is_locked") & ~F.coalesce(F.col("status").isin("disabled", "locked"), F.lit(False))
    return keys.where(ok & ((F.size(allowed) == 0) | F.array_contains(allowed, capability.lower()))).join(p, "provider_id")


def usable_pools(pools: DataFrame, tenant: str | None, app: str | None) -> DataFrame:
    quota = F.col("quota_limit").isNull() | (F.coalesce("quota_used", F.lit(0)) < F.col("quota_limit"))
    return pools.where(flag("is_enabled") & ~flag("is_locked") & quota & pool_scope("tenant_id", tenant) & pool_scope("app_id", app))


def usable_for_scope(tenants: Column, apps: Column, tenant: str, app: str) -> Column:
    """An empty or missing list allows every one."""
    fits = lambda a, x: a.isNull() | (F.size(a) == 0) | F.array_contains(a, x)
    return fits(tenants, tenant) & fits(apps, app)


def runtime_pools(pools: DataFrame, profiles: DataFrame, keys: DataFrame, providers: DataFrame, tenant: str | None = None, app: str | None = None) -> DataFrame:
    """Usable LLM pool rows with profile, key and provider, whose providers agree, in the order they are tried."""
    k = usable_keys(keys, providers, "llm").select(F.col("id").alias("key_id"), F.col("provider_id").alias("key_provider"), "provider_code")
    f = profiles.where(flag("is_enabled")).select(F.col("id").alias("profile_id"), F.col("provider_id").alias("profile_provider"), "model_name")
    found = usable_pools(pools, tenant, app).join(f, "profile_id").join(k, "key_id").where("profile_provider = key_provider")
    return found.orderBy(F.coalesce("current_position", F.lit(0)).desc(), "rotation_order", "created_at", "id")


def newest_embedding_profile(profiles: DataFrame, keys: DataFrame, providers: DataFrame) -> DataFrame:
    """The newest enabled profile that has a usable key of its provider; the row is empty where there is none."""
    k = usable_keys(keys, providers, "embedding").select(F.col("id").alias("key_id"), F.col("provider_id").alias("key_provider"), "provider_code")
    found = profiles.where(flag("is_enabled")).join(k, (F.col("api_key_id") == F.col("key_id")) & (F.col("provider_id") == F.col("key_provider")))
    return found.orderBy(F.desc("created_at"), "id").limit(1)


def top_k_setting(profiles: DataFrame) -> DataFrame:
    """The newest profile's retrieval_top_k where that is positive, else the default; older profiles are not asked."""
    newest = F.max_by("retrieval_top_k", F.struct("created_at", "id"))
    return profiles.agg(F.when(newest > 0, newest).otherwise(DEFAULT_TOP_K).cast("int").alias("top_k"))


def violations(keys: DataFrame, profiles: DataFrame, providers: DataFrame, embedding_provider: str = "gemini") -> DataFrame:
    """(what, id) of references that do not hold: unknown providers, keys of another provider, a wrong embedding provider."""
    p = providers.select(F.col("id").alias("provider_id"), "code")
    k = keys.select(F.col("id").alias("api_key_id"), F.col("provider_id").alias("key_provider"))
    told = lambda rows, what: rows.select(F.lit(what).alias("what"), "id")
    joined = profiles.join(k, "api_key_id", "left")
    return (told(keys.join(p, "provider_id", "left_anti"), "key_without_provider").unionByName(told(profiles.join(p, "provider_id", "left_anti"), "profile_without_provider"))
            .unionByName(told(joined.where("key_provider is null"), "profile_without_key")).unionByName(told(joined.where("key_provider <> provider_id"), "key_of_other_provider"))
            .unionByName(told(profiles.join(p, "provider_id").where((F.col("kind") == "embedding") & (F.lower("code") != embedding_provider)), "embedding_provider")))


def merged_keys(keys: DataFrame) -> DataFrame:
    """Keys with one hash become one: the oldest, with the capabilities of all."""
    rows = keys.groupBy("key_hash").agg(F.min_by(F.struct("id", "provider_id", "created_at"), F.struct("created_at", "id")).alias("k"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("capabilities")))).alias("capabilities"))
    return rows.select("k.id", "k.provider_id", "k.created_at", "key_hash", "capabilities")


def key_counters(events: DataFrame, key: str = "key_id") -> DataFrame:
    """events (key, ts, ok, tokens) -> calls, successes, failures, failures since the last success, and when last used."""
    last_ok = events.groupBy(key).agg(F.max(F.when(F.col("ok"), F.struct("ts", "event_id"))).alias("__last"))
    since = F.col("__last").isNull() | (F.struct("ts", "event_id") > F.col("__last"))
    return events.join(last_ok, key).groupBy(key).agg(F.count("*").alias("calls"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.count_if(~F.col("ok") & since).alias("consecutive_failures"), F.max("ts").alias("last_used_at"))


def pool_counters(keys: DataFrame, now: Column) -> DataFrame:
    """total, alive, available now, locked and the first time that a sleeping key wakes."""
    alive = flag("is_enabled") & ~flag("is_locked")
    awake = F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now)
    return keys.agg(F.count("*").alias("total"), F.count_if(alive).alias("alive"), F.count_if(alive & awake).alias("available"), F.count_if(flag("is_locked")).alias("locked"), F.min(F.when(alive & ~awake, F.col("cooldown_until"))).alias("next_wake_at"))


def usage_totals(events: DataFrame, *by: str) -> DataFrame:
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return events.groupBy(*by).agg(n("embedding_tokens").alias("embedding_tokens"), n("llm_tokens").alias("llm_tokens"), (n("embedding_tokens") + n("llm_tokens")).alias("total_tokens"))


def rotation_order(pools: DataFrame) -> DataFrame:
    """Pools with their place in rotation, by (rotation_order, name)."""
    return pools.withColumn("place", F.row_number().over(Window.partitionBy("tenant_id").orderBy("rotation_order", "name")))


#: How each listing is ordered: columns, or those that come newest first.
LISTINGS = {"providers": ("code",), "keys": ("-created_at", "id"), "embedding_profiles": ("-created_at", "id"), "models": ("model_name", "id"), "pools": ("rotation_order", "name")}


def listing(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind of configuration, in its order."""
    return rows.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in LISTINGS[kind]])


def pool_rows(pools: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pools with what their profile says, flat, in rotation order; pools without a profile go."""
    p = profiles.select(F.col("id").alias("profile_id"), "model_name", "provider_id", "api_key_id")
    return listing(pools.join(p, "profile_id"), "pools")


def key_rows(keys: DataFrame) -> DataFrame:
    """Keys as they may be shown: the secret masked, the newest first."""
    return listing(keys.withColumn("masked_key", mask_secret(F.col("secret"))).drop("secret", "key_hash"), "keys")


class KeyRing:
    """Which key comes next: round robin over keys that are neither disabled nor asleep."""

    def __init__(self, keys: list[str]):
        self.keys, self.at, self.asleep, self.disabled = keys, 0, {}, set()

    def next(self, now: float) -> str | None:
        for _ in range(len(self.keys)):
            key = self.keys[self.at % len(self.keys)]
            self.at += 1
            if key not in self.disabled and self.asleep.get(key, 0) <= now:
                return key
        return None

    def told(self, key: str, action: str, now: float, retry_after: float | None) -> None:
        """Takes account of a verdict of functions.errors."""
        if action == "disable_key":
            self.disabled.add(key)
        elif action == "cooldown_key":
            self.asleep[key] = now + (retry_after or 0)
        elif action == "retry_same":
            self.at -= 1
