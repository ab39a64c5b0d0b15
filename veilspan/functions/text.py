"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.build import lit
from veilspan.functions.arrays import let


def shannon_entropy(text: Column) -> Column:
    """Bits per character over Unicode characters; 0 for the empty string."""

    def body(t: Column) -> Column:
        n = F.char_length(t).cast("double")

        def step(acc: Column, c: Column) -> Column:
            # occurrences of one character, by how much shorter what is left gets; later ones read only that
            def taken(rest: Column) -> Column:
                share = (F.octet_length(acc["rest"]) - F.octet_length(rest)) / F.octet_length(c) / n
                return F.struct(
                    rest.alias("rest"), (acc["bits"] - let(share, lambda p: p * F.log2(p))).alias("bits")
                )

            return let(F.replace(acc["rest"], c, lit("")), taken)

        return F.aggregate(
            F.array_distinct(F.split(t, "")),
            F.struct(t.alias("rest"), lit(0.0).alias("bits")),
            step,
            lambda acc: acc["bits"],
        )

    return F.when(F.octet_length(text) == 0, lit(0.0)).otherwise(let(text, body))


def name_to_tag(name: Column) -> Column:
    """``AWS Access Key ID`` -> ``[AWS_ACCESS_KEY_ID]``; nothing left -> ``[SECRET]``."""
    return let(
        F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""),
        lambda core: F.when(core == "", lit("[SECRET]")).otherwise(
            F.concat(lit("["), F.upper(core), lit("]"))
        ),
    )


def printable_ratio(text: Column) -> Column:
    """ASCII graphic or ASCII white space characters over bytes."""
    printable = F.length(F.regexp_replace(text, "[^\\x21-\\x7e \\t\\n\\f\\r]", ""))
    return printable / F.greatest(F.octet_length(text), lit(1))


def lenient_base64(text: Column) -> Column:
    """Decode, adding missing padding and dropping a dangling last symbol.

    Stops at the first ``=``; NULL when a character is outside the alphabet.
    """

    def body(core: Column) -> Column:
        usable = F.when(
            F.length(core) % 4 == 1, F.substring(core, lit(1), F.length(core) - 1)
        ).otherwise(core)
        padded = let(
            usable,
            lambda u: F.concat(u, F.repeat(lit("="), F.pmod(-F.length(u), lit(4)))),
        )
        return F.when(core.rlike("\\A[A-Za-z0-9+/]*\\z"), F.unbase64(padded))

    return let(F.substring_index(text, "=", 1), body)


# Key words that mark a value as secret (joined by "_" in keys).
SECRET_KEY_WORDS = """
password passwd secret token api_key apikey api_secret apisecret auth_token
authtoken access_key accesskey secret_key secretkey private_key privatekey
client_secret clientsecret consumer_secret consumersecret refresh_token
refreshtoken session_key sessionkey auth_key authkey app_secret appsecret
app_key appkey db_password dbpassword database_password ssh_key sshkey pwd
passphrase cert_key certkey oci_key oci_api_key pem_key pat
personal_access_token oauth bearer jwt auth credential credentials s3_key
s3_secret slack_token discord_token github_token gitlab_token twilio stripe
payment_key secret_key publishable_key private_key encryption_key master_key
root_key admin_key service_key service_account sa_key
""".split()

# Words whose neighbouring lines are searched for tokens.
PROXIMITY_WORDS = """
password passwd secret token api_key apikey api_secret auth oauth bearer jwt
credential pem cert private_key
""".split()

# Keys that are public by design, by substring and by equality.
PUBLIC_KEY_PARTS = """
csrf xsrf verificationtoken wpnonce code_challenge user_code stripe-signature
x-hub-signature x-slack-signature x-shopify-hmac webhook-signature
""".split()
PUBLIC_KEY_NAMES = ["state", "nonce"]


def is_secret_key(key: Column) -> Column:
    """A lower-cased key holds a key word between ``_`` separators."""
    words = "|".join(dict.fromkeys(SECRET_KEY_WORDS))
    return key.rlike(f"(?:\\A|_)(?:{words})(?:_|\\z)")


def is_public_key_name(key: Column) -> Column:
    """A lower-cased key names an anti-forgery, OAuth-public or signature field."""
    return key.rlike("|".join(PUBLIC_KEY_PARTS)) | key.isin(PUBLIC_KEY_NAMES)
