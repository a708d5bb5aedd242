"""Ledger records: every schema round-trips, with and without a dictionary."""

from __future__ import annotations

import pytest

from lamina.functions import wire as w
from lamina.operators import records as r

KEY = [bytes([i]) * 32 for i in range(4)]
HEADER = {"required_signatures": 2, "readonly_signed": 0, "readonly_unsigned": 2}
INSTRUCTION = {"program_id_index": 1, "accounts": b"\0\1", "data": b"x" * 20}
BODY = {"header": HEADER, "account_keys": [KEY[0], KEY[1], KEY[0]], "recent_blockhash": KEY[3], "instructions": [INSTRUCTION]}
V0 = BODY | {"address_table_lookups": [{"account_key": KEY[1], "writable_indexes": b"\1", "readonly_indexes": b""}]}
LOADED = {"writable": [KEY[0]], "readonly": [KEY[2]]}
AMOUNT = {"ui_amount": 1.5, "decimals": 6, "amount": "1500000", "ui_amount_string": "1.5"}
BALANCE = {"account_index": 1, "mint": "m", "ui_token_amount": AMOUNT, "owner": "o", "program_id": "p"}
REWARD = {"pubkey": "k", "lamports": -5, "post_balance": 10, "reward_type": "Staking", "commission": None}
ERROR = ("InstructionError", {"index": 3, "error": ("Custom", 6000)})
META = {
    "status": (False, ERROR), "fee": 5000, "pre_balances": [1, 2], "post_balances": [1, 1], "inner_instructions": [{"index": 0, "instructions": [{"instruction": INSTRUCTION, "stack_height": 2}]}],
    "log_messages": ["a", "b"], "pre_token_balances": [BALANCE], "post_token_balances": None, "rewards": [REWARD], "loaded_addresses": LOADED,
    "return_data": {"program_id": KEY[0], "data": b"1"}, "compute_units_consumed": 7, "cost_units": None,
}
VALUES = {
    "Pubkey": KEY[1], "Hash": KEY[2], "Signature": b"s" * 64, "MessageHeader": HEADER, "CompiledInstruction": INSTRUCTION, "LegacyMessageBody": BODY,
    "MessageAddressTableLookup": V0["address_table_lookups"][0], "V0Message": V0, "LegacyMessage": {"message": BODY, "is_writable_account_cache": [True, False]},
    "SanitizedMessage": ("V0", {"message": V0, "loaded_addresses": LOADED, "is_writable_account_cache": [True]}), "LoadedAddresses": LOADED,
    "LoadedMessage": {"message": V0, "loaded_addresses": LOADED, "is_writable_account_cache": []}, "VersionedMessage": ("Legacy", BODY),
    "VersionedTransaction": {"signatures": [b"s" * 64], "message": ("V0", V0)},
    "SanitizedTransaction": {"message": ("Legacy", {"message": BODY, "is_writable_account_cache": []}), "message_hash": KEY[0], "is_simple_vote": False, "signatures": []},
    "InnerInstruction": {"instruction": INSTRUCTION, "stack_height": None}, "InnerInstructions": {"index": 0, "instructions": []}, "UiTokenAmount": AMOUNT,
    "TransactionTokenBalance": BALANCE, "RewardType": "Voting", "Reward": REWARD, "RewardsAndNumPartitions": {"rewards": [REWARD], "num_partitions": 4},
    "TransactionReturnData": {"program_id": KEY[0], "data": b"1"}, "InstructionError": ("Custom", 1), "TransactionError": ERROR, "TransactionStatusMeta": META,
    "SlotStatus": ("Dead", "why"), "PluginError": ("Custom", "text"),
}


@pytest.mark.parametrize("name", r.RECORDS)
def test_round_trip(name):
    kind, value = r.RECORDS[name], VALUES[name]
    assert kind.loads(kind.dumps(value)) == value
    assert kind.loads(kind.dumps(value, w.Context.with_all()), w.Context.with_all()) == value


def test_layouts():
    header = lambda a, b, c: r.MESSAGE_HEADER.dumps({"required_signatures": a, "readonly_signed": b, "readonly_unsigned": c}).hex()
    assert (header(2, 0, 2), header(1, 0, 0), header(0, 0, 0)) == ("83020002", "01", "00")
    assert len(r.INSTRUCTION_ERRORS) == 54 and len(r.TRANSACTION_ERRORS) == 39
    assert r.INSTRUCTION_ERROR.dumps(("Custom", 1)).hex() == "1901" and r.INSTRUCTION_ERROR.dumps("BuiltinProgramsMustConsumeComputeUnits").hex() == "35"
    assert r.TRANSACTION_ERROR.dumps("CommitCancelled").hex() == "26" and r.TRANSACTION_ERROR.dumps(("DuplicateInstruction", 4)).hex() == "1e04"


def test_keys_are_deduped_across_a_record():
    ctx = w.Context(w.Dictionary())
    assert len(r.LEGACY_MESSAGE_BODY.dumps(BODY)) - len(r.LEGACY_MESSAGE_BODY.dumps(BODY, ctx)) == 96 - (33 + 33 + 1)
    assert len(r.PUBKEY.dumps(KEY[1], ctx)) == 1
