"""Two-phase evaluation of prompt / response exchanges, and the dry run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import truthy
from vigilake.operators.classify import Recognizer, with_hits
from vigilake.operators.evaluate import Clock, evaluate
from vigilake.operators.policies import PolicySet
from vigilake.operators.taxonomy import Taxonomy

# How the phases act on each other and what a receipt records.
CHAT = "chat"  # a redacted prompt is forwarded and recorded
PASSTHROUGH = "passthrough"  # the original prompt is forwarded and recorded
MODES = (CHAT, PASSTHROUGH)

# Fixed value: what a receipt of a lone response phase holds as its prompt.
LONE_RESPONSE_PROMPT = "Extension response check"


def evaluate_exchanges(
    exchanges: DataFrame,
    taxonomies: list[Taxonomy],
    policy_set: PolicySet,
    clock: Clock,
    *,
    mode: str = CHAT,
    key: str = "exchange_id",
    destination: Column | str = "external_vendor",
    recognizer: Recognizer | None = None,
) -> DataFrame:
    """Evaluate ``prompt`` and, unless that was blocked, ``response`` of each row.

    Adds prompt_eval, response_eval, verdict, block_message and, for the receipt,
    final_prompt, final_response, all_hits and decisions. A blocked prompt nulls
    the response before its regexes run.
    """
    if mode not in MODES:
        raise ValueError(f"a mode is one of {MODES}, got {mode!r}")

    def error_of(phase):
        name = f"classifier_error_{phase}"
        return F.col(name) if name in exchanges.columns else None

    prompts = with_hits(exchanges, "prompt", taxonomies, "prompt", "prompt_hits", recognizer)
    first = evaluate(
        prompts, policy_set, text="prompt", hits="prompt_hits", direction="prompt", clock=clock, key=key,
        destination=destination, error=error_of("prompt"), out="prompt_eval",
    )
    stopped = F.coalesce(F.col("prompt_eval.final_verdict") == "blocked", F.lit(False))
    answered = first.withColumn("__answer", F.when(~stopped, F.col("response")))
    answers = with_hits(answered, "__answer", taxonomies, "response", "response_hits", recognizer)
    second = evaluate(
        answers, policy_set, text="__answer", hits="response_hits", direction="response", clock=clock, key=key,
        destination=destination, error=error_of("response"), out="response_eval",
    )
    verdicts = (F.col("prompt_eval.final_verdict"), F.col("response_eval.final_verdict"))

    def either(verdict):
        return F.coalesce(verdicts[0] == verdict, F.lit(False)) | F.coalesce(verdicts[1] == verdict, F.lit(False))

    sent = F.coalesce(truthy(F.col("prompt_eval.mutated_text")), F.col("prompt")) if mode == CHAT else F.col("prompt")
    # A response blocked on its way back is still recorded in full.
    answer = F.coalesce(truthy(F.col("response_eval.mutated_text")), F.col("__answer"), F.lit(""))
    none = F.array()
    return second.withColumns(
        {
            # An alert does not show in the overall verdict.
            "verdict": F.when(either("blocked"), F.lit("blocked"))
            .when(either("redacted"), F.lit("redacted"))
            .otherwise(F.lit("allowed")),
            "block_message": F.coalesce("prompt_eval.block_user_message", "response_eval.block_user_message"),
            "final_prompt": F.when(stopped, F.col("prompt")).otherwise(sent),
            "final_response": answer,
            "all_hits": F.concat("prompt_hits", "response_hits"),
            "decisions": F.concat(
                F.coalesce("prompt_eval.decisions", none), F.coalesce("response_eval.decisions", none)
            ),
        }
    ).drop("__answer")


def evaluate_single_phase(
    records: DataFrame,
    taxonomies: list[Taxonomy],
    policy_set: PolicySet,
    clock: Clock,
    *,
    key: str = "exchange_id",
    recognizer: Recognizer | None = None,
) -> DataFrame:
    """Evaluate records of one phase each: ``direction`` says which, ``text`` holds it.

    Every record yields a receipt. A response record stands for its own phase
    only, so its receipt carries a fixed note in place of the prompt.
    """
    texts = records.withColumns(
        {
            "prompt": F.when(F.col("direction") == "prompt", F.col("text")),
            "response": F.when(F.col("direction") == "response", F.col("text")),
        }
    )
    done = evaluate_exchanges(texts, taxonomies, policy_set, clock, mode=PASSTHROUGH, key=key, recognizer=recognizer)
    is_prompt = F.col("direction") == "prompt"
    evaluation = F.coalesce("prompt_eval", "response_eval")
    return done.withColumns(
        {
            "verdict": evaluation["final_verdict"],
            "text_out": F.coalesce(truthy(evaluation["mutated_text"]), F.col("text")),
            "final_prompt": F.when(is_prompt, F.col("text")).otherwise(F.lit(LONE_RESPONSE_PROMPT)),
            "final_response": F.when(is_prompt, F.lit("")).otherwise(F.col("final_response")),
        }
    )


def dry_run(
    texts: DataFrame,
    taxonomies: list[Taxonomy],
    policy_set: PolicySet,
    clock: Clock,
    *,
    key: str = "exchange_id",
    destination: Column | str = "external_vendor",
) -> DataFrame:
    """Phase-by-phase outcome for texts, with no receipt: one row per text given.

    Both phases are evaluated on their own; a blocked prompt does not stop the response.
    """
    parts = []
    for phase in ("prompt", "response"):
        if phase not in texts.columns:
            continue
        given = texts.where(F.col(phase).isNotNull()).select(key, F.lit(phase).alias("phase"), F.col(phase).alias("text"))
        tagged = with_hits(given, "text", taxonomies, phase)
        parts.append(
            evaluate(
                tagged, policy_set, text="text", hits="hits", direction=phase, clock=clock, key=key,
                destination=destination,
            ).select(key, "phase", "evaluation.*")
        )
    if not parts:
        raise ValueError("a dry run needs a prompt or a response column")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
