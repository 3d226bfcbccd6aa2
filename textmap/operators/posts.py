"""Posts: listing, lookup and the rules that their fields must meet."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 20
MAX_LENGTH = 255


@dataclass(frozen=True)
class FieldRule:
    field: str
    required: bool = True
    max_length: int | None = None


# Fields every post must have, then those of each kind of post.
POST_RULES = (FieldRule("created_at"), FieldRule("title", True, MAX_LENGTH), FieldRule("slug", True, MAX_LENGTH))
TYPE_RULES = {
    "BlogPost": (FieldRule("body"),),
    "Video": (FieldRule("embed_code"),),
    "Image": (FieldRule("image_url", True, MAX_LENGTH),),
    "Quote": (FieldRule("body"), FieldRule("author", True, MAX_LENGTH)),
}
COMMENT_RULES = (FieldRule("created_at"), FieldRule("body"), FieldRule("author", True, MAX_LENGTH))

POST_SCHEMA = (
    "doc_id long, post_type string, created_at timestamp, title string, slug string, body string, "
    "embed_code string, image_url string, author string, extras map<string,string>, "
    "comments array<struct<created_at: timestamp, body: string, author: string>>"
)


def list_posts(posts: DataFrame, page: int = 0, page_size: int = PAGE_SIZE) -> DataFrame:
    """(doc_id, created_at, title): one page of posts, newest first."""
    listed = posts.select("doc_id", "created_at", "title").orderBy(F.desc("created_at"), "doc_id")
    return listed.offset(page * page_size).limit(page_size)


def get_post(posts: DataFrame, doc_id: int) -> DataFrame:
    return posts.where(F.col("doc_id") == doc_id)


def _broken(rule: FieldRule, value: Column, when: Column, name: str) -> list[Column]:
    text = F.coalesce(value.cast("string"), F.lit(""))

    def violation(kind: str) -> Column:
        return F.struct(F.lit(name).alias("field"), F.lit(kind).alias("rule"))

    found = []
    if rule.required:
        found.append(F.when(when & (F.length(text) == 0), violation("required")))
    if rule.max_length is not None:
        found.append(F.when(when & (F.length(text) > rule.max_length), violation("max_length")))
    return found


def violations(posts: DataFrame) -> DataFrame:
    """(doc_id, field, rule): one row per broken rule of a post, its kind and its comments."""
    present = set(posts.columns)
    checks = [c for r in POST_RULES if r.field in present for c in _broken(r, F.col(r.field), F.lit(True), r.field)]
    if "post_type" in present:
        for kind, rules in TYPE_RULES.items():
            is_kind = F.col("post_type") == kind
            checks += [c for r in rules if r.field in present for c in _broken(r, F.col(r.field), is_kind, r.field)]
    broken = F.filter(F.array(*checks), lambda v: v.isNotNull())
    if "comments" in present:
        per_comment = F.transform(
            F.coalesce("comments", F.array().cast(posts.schema["comments"].dataType)),
            lambda c: F.filter(
                F.array(*[v for r in COMMENT_RULES for v in _broken(r, c[r.field], F.lit(True), f"comments.{r.field}")]),
                lambda v: v.isNotNull(),
            ),
        )
        broken = F.concat(broken, F.flatten(per_comment))
    return posts.select("doc_id", F.inline(broken))


def node_posts(posts: DataFrame, assigned: DataFrame, node: int) -> DataFrame:
    """Posts whose document landed on ``node``."""
    return posts.join(assigned.where(F.col("node") == node).select("doc_id"), "doc_id", "left_semi")
