"""Schemas of the ledger record types: codecs by name, fields in wire order, registered as record.<name>.

columns.encode_value(column, "record.Reward") and the folds of columns.py, for those with public keys in a dictionary or
blobs in deltas, take them as they are; schema_of() is the Spark schema.

A public key is the one dictionary-eligible leaf; signatures and hashes never take part in deltas.
"""

from __future__ import annotations

from pyspark.sql.types import StructField, StructType

from ..functions.wire import (
    BOOL, BYTES, F64, I64, STR, U8, U32, U64, Enum, FixedBytes, InvalidData, Keyed, Mapped, Option, Result, Struct, Type, UNIT, Vec, registry,
)
from .columns import spark_type

# Fixed values of the format: names and order of the variants are their discriminants.
INSTRUCTION_ERRORS = """
GenericError InvalidArgument InvalidInstructionData InvalidAccountData AccountDataTooSmall InsufficientFunds
IncorrectProgramId MissingRequiredSignature AccountAlreadyInitialized UninitializedAccount UnbalancedInstruction
ModifiedProgramId ExternalAccountLamportSpend ExternalAccountDataModified ReadonlyLamportChange ReadonlyDataModified
DuplicateAccountIndex ExecutableModified RentEpochModified NotEnoughAccountKeys AccountDataSizeChanged
AccountNotExecutable AccountBorrowFailed AccountBorrowOutstanding DuplicateAccountOutOfSync Custom InvalidError
ExecutableDataModified ExecutableLamportChange ExecutableAccountNotRentExempt UnsupportedProgramId CallDepth
MissingAccount ReentrancyNotAllowed MaxSeedLengthExceeded InvalidSeeds InvalidRealloc ComputationalBudgetExceeded
PrivilegeEscalation ProgramEnvironmentSetupFailure ProgramFailedToComplete ProgramFailedToCompile Immutable
IncorrectAuthority BorshIoError AccountNotRentExempt InvalidAccountOwner ArithmeticOverflow UnsupportedSysvar
IllegalOwner MaxAccountsDataAllocationsExceeded MaxAccountsExceeded MaxInstructionTraceLengthExceeded
BuiltinProgramsMustConsumeComputeUnits
""".split()
TRANSACTION_ERRORS = """
AccountInUse AccountLoadedTwice AccountNotFound ProgramAccountNotFound InsufficientFundsForFee InvalidAccountForFee
AlreadyProcessed BlockhashNotFound InstructionError CallChainTooDeep MissingSignatureForFee InvalidAccountIndex
SignatureFailure InvalidProgramForExecution SanitizeFailure ClusterMaintenance AccountBorrowOutstanding
WouldExceedMaxBlockCostLimit UnsupportedVersion InvalidWritableAccount WouldExceedMaxAccountCostLimit
WouldExceedAccountDataBlockLimit TooManyAccountLocks AddressLookupTableNotFound InvalidAddressLookupTableOwner
InvalidAddressLookupTableData InvalidAddressLookupTableIndex InvalidRentPayingAccount WouldExceedMaxVoteCostLimit
WouldExceedAccountDataTotalLimit DuplicateInstruction InsufficientFundsForRent MaxLoadedAccountsDataSizeExceeded
InvalidLoadedAccountsDataSizeLimit ResanitizationNeeded ProgramExecutionTemporarilyRestricted UnbalancedTransaction
ProgramCacheHitMaxLimit CommitCancelled
""".split()
SLOT_STATUSES = ["Processed", "Rooted", "Confirmed", "FirstShredReceived", "Completed", "CreatedBank", "Dead"]
PLUGIN_ERRORS = ["ConfigFileOpenError", "ConfigFileReadError", "AccountsUpdateError", "SlotStatusUpdateError", "Custom", "TransactionUpdateError"]
REWARD_TYPES = ["Fee", "Rent", "Staking", "Voting"]


def _pack_header(h: dict) -> int:
    return h["required_signatures"] | h["readonly_signed"] << 8 | h["readonly_unsigned"] << 16


def _unpack_header(n: int) -> dict:
    if n >> 24:
        raise InvalidData("a header has three bytes")
    return {"required_signatures": n & 255, "readonly_signed": n >> 8 & 255, "readonly_unsigned": n >> 16}


_HEADER = Struct(("required_signatures", U8), ("readonly_signed", U8), ("readonly_unsigned", U8))
PUBKEY = Keyed("pubkey", FixedBytes(32, delta=False))
HASH = FixedBytes(32, delta=False)
SIGNATURE = FixedBytes(64, delta=False)
MESSAGE_HEADER = Mapped(U32, lambda h: _pack_header(h if isinstance(h, dict) else dict(zip(_HEADER.names, h, strict=True))), _unpack_header, _HEADER)
COMPILED_INSTRUCTION = Struct(("program_id_index", U8), ("accounts", BYTES), ("data", BYTES))
_MESSAGE = (("header", MESSAGE_HEADER), ("account_keys", Vec(PUBKEY)), ("recent_blockhash", HASH), ("instructions", Vec(COMPILED_INSTRUCTION)))
LEGACY_MESSAGE_BODY = Struct(*_MESSAGE)
ADDRESS_TABLE_LOOKUP = Struct(("account_key", PUBKEY), ("writable_indexes", BYTES), ("readonly_indexes", BYTES))
V0_MESSAGE = Struct(*_MESSAGE, ("address_table_lookups", Vec(ADDRESS_TABLE_LOOKUP)))
LEGACY_MESSAGE = Struct(("message", LEGACY_MESSAGE_BODY), ("is_writable_account_cache", Vec(BOOL)))
LOADED_ADDRESSES = Struct(("writable", Vec(PUBKEY)), ("readonly", Vec(PUBKEY)))
LOADED_MESSAGE = Struct(("message", V0_MESSAGE), ("loaded_addresses", LOADED_ADDRESSES), ("is_writable_account_cache", Vec(BOOL)))
SANITIZED_MESSAGE = Enum(("Legacy", LEGACY_MESSAGE), ("V0", LOADED_MESSAGE))
VERSIONED_MESSAGE = Enum(("Legacy", LEGACY_MESSAGE_BODY), ("V0", V0_MESSAGE))
VERSIONED_TRANSACTION = Struct(("signatures", Vec(SIGNATURE)), ("message", VERSIONED_MESSAGE))
SANITIZED_TRANSACTION = Struct(("message", SANITIZED_MESSAGE), ("message_hash", HASH), ("is_simple_vote", BOOL), ("signatures", Vec(SIGNATURE)))
INNER_INSTRUCTION = Struct(("instruction", COMPILED_INSTRUCTION), ("stack_height", Option(U32)))
INNER_INSTRUCTIONS = Struct(("index", U8), ("instructions", Vec(INNER_INSTRUCTION)))
TOKEN_AMOUNT = Struct(("ui_amount", Option(F64)), ("decimals", U8), ("amount", STR), ("ui_amount_string", STR))
TOKEN_BALANCE = Struct(("account_index", U8), ("mint", STR), ("ui_token_amount", TOKEN_AMOUNT), ("owner", STR), ("program_id", STR))
REWARD_TYPE = Enum(*REWARD_TYPES)
REWARD = Struct(("pubkey", STR), ("lamports", I64), ("post_balance", U64), ("reward_type", Option(REWARD_TYPE)), ("commission", Option(U8)))
REWARDS = Struct(("rewards", Vec(REWARD)), ("num_partitions", Option(U64)))
RETURN_DATA = Struct(("program_id", PUBKEY), ("data", BYTES))
INSTRUCTION_ERROR = Enum(*[("Custom", U32) if n == "Custom" else n for n in INSTRUCTION_ERRORS])
_ERROR_BODIES = {"InstructionError": Struct(("index", U8), ("error", INSTRUCTION_ERROR)), "DuplicateInstruction": U8, "InsufficientFundsForRent": U8, "ProgramExecutionTemporarilyRestricted": U8}
TRANSACTION_ERROR = Enum(*[(n, _ERROR_BODIES[n]) if n in _ERROR_BODIES else n for n in TRANSACTION_ERRORS])
STATUS_META = Struct(
    ("status", Result(UNIT, TRANSACTION_ERROR)), ("fee", U64), ("pre_balances", Vec(U64)), ("post_balances", Vec(U64)),
    ("inner_instructions", Option(Vec(INNER_INSTRUCTIONS))), ("log_messages", Option(Vec(STR))),
    ("pre_token_balances", Option(Vec(TOKEN_BALANCE))), ("post_token_balances", Option(Vec(TOKEN_BALANCE))),
    ("rewards", Option(Vec(REWARD))), ("loaded_addresses", LOADED_ADDRESSES), ("return_data", Option(RETURN_DATA)),
    ("compute_units_consumed", Option(U64)), ("cost_units", Option(U64)),
)
SLOT_STATUS = Enum(*[("Dead", STR) if n == "Dead" else n for n in SLOT_STATUSES])
PLUGIN_ERROR = Enum(*[(n, STR) for n in PLUGIN_ERRORS])

RECORDS: dict[str, Type] = {
    "Pubkey": PUBKEY, "Hash": HASH, "Signature": SIGNATURE, "MessageHeader": MESSAGE_HEADER, "CompiledInstruction": COMPILED_INSTRUCTION,
    "LegacyMessageBody": LEGACY_MESSAGE_BODY, "MessageAddressTableLookup": ADDRESS_TABLE_LOOKUP, "V0Message": V0_MESSAGE, "LegacyMessage": LEGACY_MESSAGE,
    "SanitizedMessage": SANITIZED_MESSAGE, "LoadedAddresses": LOADED_ADDRESSES, "LoadedMessage": LOADED_MESSAGE, "VersionedMessage": VERSIONED_MESSAGE,
    "VersionedTransaction": VERSIONED_TRANSACTION, "SanitizedTransaction": SANITIZED_TRANSACTION, "InnerInstruction": INNER_INSTRUCTION, "InnerInstructions": INNER_INSTRUCTIONS,
    "UiTokenAmount": TOKEN_AMOUNT, "TransactionTokenBalance": TOKEN_BALANCE, "RewardType": REWARD_TYPE, "Reward": REWARD, "RewardsAndNumPartitions": REWARDS,
    "TransactionReturnData": RETURN_DATA, "InstructionError": INSTRUCTION_ERROR, "TransactionError": TRANSACTION_ERROR, "TransactionStatusMeta": STATUS_META,
    "SlotStatus": SLOT_STATUS, "PluginError": PLUGIN_ERROR,
}

for _name, _kind in RECORDS.items():
    registry.register(f"record.{_name}", _kind)


def schema_of(name: str) -> StructType:
    """The record's Spark schema, a single field value for records that are no struct."""
    kind = spark_type(RECORDS[name])
    return kind if isinstance(kind, StructType) else StructType([StructField("value", kind)])
