"""Column builders over measurement records (`factors`, `parsed`, `rss`, `provenance`)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024.0 * 1024.0

# Fixed values of the measured systems.
FULLY_OFFLOADED = 99
DEFAULT_UBATCH = 512
CHECKPOINT_STEP = 8192
KV_CACHE_PAD = 256
ATTENTION_CHUNK = 512
MOE_OFFLOAD_RATIO = 32
FUSED_MASK_BYTES = 2
UNFUSED_MASK_BYTES = 4
LATENT_ARCHS = ["deepseek4", "deepseek2", "glm-dsa"]
QUANTISED_KV = ["q8_0", "q5_1", "q5_0", "q4_1", "q4_0", "iq4_nl"]
WEIGHT_TOLERANCE = 0.01


@dataclass
class Rates:
    """Constants a derivation reads; earlier derivations fill in later ones."""

    values: dict[str, float] = field(default_factory=dict)

    def get(self, name: str) -> float:
        return float(self.values.get(name, 0.0))

    def with_value(self, name: str, value: float | None) -> "Rates":
        return self if value is None else Rates({**self.values, name: float(value)})


def factor(name: str) -> Column:
    return F.col(f"factors.{name}")


def parsed(name: str) -> Column:
    return F.col(f"parsed.{name}")


def is_ok() -> Column:
    return F.col("status") == "ok"


def instant_ms(stamp: Column) -> Column:
    """An ISO stamp as epoch milliseconds; an unreadable one reads as the epoch."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(stamp)), F.lit(0).cast("long"))


def measured_ms() -> Column:
    return instant_ms(F.col("provenance.measured_at_utc"))


# --- factors ---------------------------------------------------------------


def split_or_layer() -> Column:
    return F.coalesce(factor("split"), F.lit("layer"))


def gpu_ids() -> Column:
    return F.filter(F.split(factor("gpus"), ","), lambda x: x != "")


def cards_or(default: int) -> Column:
    return F.when(factor("gpus") == "", F.lit(default)).otherwise(F.size(F.split(factor("gpus"), ",")))


def cards_nonempty() -> Column:
    return F.greatest(F.size(gpu_ids()), F.lit(1))


def ubatch_or_default() -> Column:
    return F.coalesce(F.nullif(factor("ubatch"), F.lit(0).cast("long")), F.lit(DEFAULT_UBATCH).cast("long"))


def tokens() -> Column:
    return F.least(factor("ctx"), ubatch_or_default())


def flash_on() -> Column:
    return factor("flash_attn") == "on"


def flash_off() -> Column:
    return factor("flash_attn") == "off"


def charged_unfused() -> Column:
    return factor("flash_attn") != "on"


def mask_width() -> Column:
    return F.when(charged_unfused(), F.lit(UNFUSED_MASK_BYTES)).otherwise(F.lit(FUSED_MASK_BYTES))


def kv_quantised() -> Column:
    return factor("kv_type").isin(QUANTISED_KV)


def fully_offloaded() -> Column:
    return factor("ngl") == FULLY_OFFLOADED


def is_hybrid() -> Column:
    return F.coalesce(factor("n_cpu_moe"), F.lit(0)) != 0


def present(name: str) -> Column:
    """Set and not empty."""
    return F.coalesce(factor(name), F.lit("")) != ""


def has_spec() -> Column:
    return present("spec_type")


def is_ik() -> Column:
    return factor("runtime") == "ik"


def layer_split_copies() -> Column:
    """A layer split over several cards replicates its masks."""
    return F.when((cards_or(1) > 1) & (split_or_layer() == "layer"), F.lit(4.0)).otherwise(F.lit(1.0))


# --- readings --------------------------------------------------------------


def owned_bytes() -> Column:
    return (F.col("rss.rss_anon_kb") + F.col("rss.rss_shmem_kb")) * 1024


def owned_mib() -> Column:
    return F.expr("(rss.rss_anon_kb + rss.rss_shmem_kb) div 1024")


def gpu_used() -> Column:
    """Driver total in MiB; zero reads as absent."""
    return F.nullif(F.col("rss.gpu_used_mib"), F.lit(0).cast("long"))


def card_used(card: Column) -> Column:
    return F.nullif(F.try_element_at(F.col("rss.per_card"), card), F.lit(0).cast("long"))


def cards_measured() -> Column:
    return F.size(F.map_filter(F.col("rss.per_card"), lambda k, v: v > 0))


def arena() -> Column:
    return F.nullif(parsed("arena_mib"), F.lit(0.0))


# --- keys ------------------------------------------------------------------


def arch_named() -> Column:
    return F.nullif(parsed("arch"), F.lit(""))


def variant() -> Column:
    return F.concat(
        F.coalesce(arch_named(), F.lit("None")),
        F.when(parsed("n_expert") != 0, F.lit("+moe")).otherwise(F.lit("")),
        F.when(parsed("per_layer_token_embd"), F.lit("+e")).otherwise(F.lit("")),
    )


def variant_environment() -> Column:
    return F.concat(
        variant(), F.when(is_ik(), F.lit("@ik")).otherwise(F.lit("")), F.when(charged_unfused(), F.lit("@nofa")).otherwise(F.lit(""))
    )


def arch_cards() -> Column:
    return F.concat(parsed("arch"), F.lit("@"), cards_or(1).cast("string"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# --- shape -----------------------------------------------------------------


def gguf(suffix: str) -> Column:
    """A metadata number of the record's own architecture, null when absent."""
    return F.when(parsed("arch") != "", F.try_element_at(parsed("gguf_kv"), F.concat(parsed("arch"), F.lit("." + suffix))))


def _or(first: Column, second: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.coalesce(F.nullif(first, zero), second)


def query_heads() -> Column:
    """Attention heads, inferred as width over key length where the file omits them."""
    width = _or(gguf("embedding_length"), parsed("n_embd"))
    length = F.nullif(_or(gguf("attention.key_length"), parsed("n_embd_head_k")), F.lit(0).cast("long"))
    inferred = F.greatest(F.floor(width / length), F.lit(0))
    return _or(parsed("n_head"), F.coalesce(inferred, F.lit(0).cast("long")))


def _role(buffers: Column, role: str) -> Column:
    return F.coalesce(F.try_element_at(buffers, F.lit(role)), F.lit(0.0))


def _add(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, e: acc + of(e))


def resident_weights() -> Column:
    """MiB of weights a record reports, over host, device table and contexts."""
    tables = _add(parsed("devices"), lambda d: d["model_mib"].cast("double"))
    contexts = _add(parsed("contexts"), lambda c: _add(F.map_values(c["buffers"]), lambda b: _role(b, "model")))
    return parsed("cpu_model_mib") + tables + contexts


def same_weights(a: Column, b: Column, tolerance: float = WEIGHT_TOLERANCE) -> Column:
    """Both halves of a pair loaded the same weights; an unknown side passes."""
    return (a == 0) | (b == 0) | (F.abs(a - b) / F.nullif(F.greatest(a, b), F.lit(0.0)) <= tolerance)


def _cuda_only(buffers: Column) -> Column:
    return F.map_values(F.map_filter(buffers, lambda k, v: k.startswith("CUDA") & ~k.endswith("Host")))


def table_less_compute() -> Column:
    """Per-device remainder for a runtime that prints no breakdown: total - weights - cache."""
    def over(roles: list[str]) -> Column:
        def one(b: Column) -> Column:
            out = _role(b, roles[0])
            for r in roles[1:]:
                out = out + _role(b, r)
            return out
        return _add(parsed("contexts"), lambda c: _add(_cuda_only(c["buffers"]), one))

    weights, cache = over(["model"]), over(["kv", "rs"])
    remainder = gpu_used().cast("double") - weights - cache
    return F.when((weights != 0) & (remainder > 0), remainder / cards_nonempty())


def context_sums(contexts: Column) -> Column:
    """Cache, recurrent and compute MiB on devices per context, equal entries collapsed in order."""
    def on_devices(c: Column, role: str) -> Column:
        kept = F.map_filter(c["buffers"], lambda k, v: ~k.endswith("_Host") & ~k.startswith("CPU"))
        return _add(F.map_values(kept), lambda b: _role(b, role))

    sums = F.transform(
        contexts,
        lambda c: F.struct(
            _add(c["kv_pools"], lambda p: p["total_mib"]).alias("kv"), on_devices(c, "rs").alias("rs"), on_devices(c, "compute").alias("compute")
        ),
    )
    return F.array_distinct(sums)


def draft_context(sums: Column) -> Column:
    return F.when(F.size(sums) > 1, F.try_element_at(sums, F.lit(1)))


def main_context(sums: Column) -> Column:
    return F.try_element_at(sums, F.lit(-1))


# --- memory models ---------------------------------------------------------


def _ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b)


def pad_cells(cells: Column) -> Column:
    return F.greatest(_ceil_div(cells, F.lit(KV_CACHE_PAD)), F.lit(1)) * KV_CACHE_PAD


def window_copies(window: Column, batch: Column, shared: Column) -> Column:
    """One mask per batch the window spans, at most two, plus the batch's own."""
    return F.when(shared, 1 + F.least(_ceil_div(window, batch), F.lit(2))).otherwise(F.lit(1))


def arena_terms(rates: Rates, charge_moe: bool = True) -> dict[str, Column]:
    """The graph arena's modelled MiB: attention masks, window masks, hidden inputs."""
    ctx, slots, unified = factor("ctx"), factor("parallel"), factor("kv_unified")
    share = F.when(is_ik() | unified | (slots == 1), ctx).otherwise(F.floor(ctx / F.greatest(slots, F.lit(1))))
    cells, batch, width = pad_cells(share), tokens(), mask_width()
    plain = cells * batch * width
    sparse = is_ik() & F.coalesce(F.array_contains(factor("extra"), "-dsa"), F.lit(False))
    mask = F.when(sparse, plain * 3).when(parsed("arch").isin(LATENT_ARCHS), F.floor(plain / 2)).otherwise(plain)
    window = parsed("n_swa")
    rows = F.when(is_ik(), cells).otherwise(pad_cells(window + batch))
    copies = window_copies(window, batch, (slots > 1) & unified & ~is_ik())
    swa = F.when(window != 0, copies * rows * batch * width).otherwise(F.lit(0))
    hidden = F.when(is_ik(), F.lit(1)).otherwise(F.lit(2)) * parsed("n_embd") * batch * 4
    if charge_moe:
        experts, used = parsed("n_expert"), parsed("n_expert_used")
        below = (experts != 0) & (used != 0) & (batch * used < MOE_OFFLOAD_RATIO * experts)
        ik_rate = F.lit(max(int(rates.get("ik_moe_rate")), 0))
        tensor_rate = F.lit(max(int(rates.get("tensor_moe_rate")), 0))
        rate = F.when(is_ik(), ik_rate).when(is_hybrid() & (split_or_layer() == "tensor"), tensor_rate).otherwise(F.lit(0))
        hidden = hidden + F.when(below, rate * parsed("n_embd") * batch).otherwise(F.lit(0))
    return {"mask": mask / F.lit(MIB), "swa": swa / F.lit(MIB), "hidden": hidden / F.lit(MIB)}


def recurrent_state(pool: Column) -> Column:
    """Modelled R and S MiB of a recurrent pool; null where the model is not recurrent."""
    conv, cache = gguf("ssm.conv_kernel"), gguf("shortconv.l_cache")
    inner, state, groups = gguf("ssm.inner_size"), gguf("ssm.state_size"), gguf("ssm.group_count")
    gated = F.coalesce(conv, F.lit(0)) != 0
    short = F.coalesce(cache, F.lit(0)) > 1
    width_r = F.when(gated, (conv - 1) * (inner + 2 * groups * state)).when(short, gguf("embedding_length") * (cache - 1))
    width_s = F.when(gated, state * inner).when(short, F.lit(0).cast("long"))
    interval = F.nullif(gguf("full_attention_interval"), F.lit(0).cast("long"))
    layers = pool["layers"] - F.floor(pool["layers"] / interval)
    scale = (layers * pool["seqs"] * (pool["rs_seq"] + 1) * 4) / F.lit(MIB)
    return F.when(
        width_r.isNotNull() & width_s.isNotNull() & scale.isNotNull(), F.struct((width_r * scale).alias("r"), (width_s * scale).alias("s"))
    )


COLUMNS = ["flat", "head_flat", "hidden", "doubling", "mask", "quant", "logits", "offload_head"]


def design_columns(
    ubatch: Column, n_kv: Column, ctx: Column, quantised: Column, head_share: Column, n_vocab: Column, n_embd: Column, offloading: Column, copies: Column
) -> dict[str, Column]:
    """The compute model's regressors, normalised so models of any width share coefficients."""
    zero = F.lit(0.0)
    chunk = float(ATTENTION_CHUNK)
    return {
        "flat": F.lit(1.0),
        "head_flat": head_share,
        "hidden": n_embd * ubatch / F.lit(MIB),
        "doubling": F.log2(F.greatest(ubatch.cast("double"), F.lit(chunk)) / F.lit(chunk)),
        "mask": copies * ubatch * n_kv / F.lit(MIB),
        "quant": F.when(quantised, ubatch * ctx / F.lit(MIB)).otherwise(zero),
        "logits": head_share * n_vocab * ubatch / F.lit(MIB),
        "offload_head": F.when(offloading, head_share).otherwise(zero),
    }


# --- audits ----------------------------------------------------------------


def axis(name: str) -> Column:
    return (ubatch_or_default() if name == "ubatch" else factor(name)).cast("string")


CONFIGURATION = [
    "model", "runtime", "gpus", "ctx", "ubatch", "parallel", "ngl", "split", "kv_type", "kv_unified", "flash_attn", "n_cpu_moe", "mmproj",
    "draft", "spec_type", "no_mmap", "rtr", "cram", "soak", "concurrency", "probe_prompt_tokens", "embeddings", "bench", "served", "numa", "extra",
]


def cell_id(factors: str, defaults: dict) -> Column:
    """Twelve hex digits over the sorted non-default factors; label and purpose stay out."""
    skipped = {"label", "purpose"}
    parts = []
    for name in sorted(set(defaults) - skipped):
        value = F.col(f"{factors}.{name}")
        default = defaults[name]
        text = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
        same = value.isNull() if default is None else value.eqNullSafe(F.lit(default))
        parts.append(F.when(~same, text))
    return F.substring(F.sha2(F.array_join(F.array_compact(F.array(*parts)), ","), 256), 1, 12)
