"""The pack of 18 rules for Solidity sources."""

from __future__ import annotations

from codesift.functions.dialect import BLANK
from codesift.rules import Rule, RulePack


def _one_per_segment(head: str, skip_head: str, body: str) -> str:
    """A linear form for rules of the shape HEAD ``[^)]*`` TAIL.

    Such a match never crosses a closing parenthesis, so between two of them only
    the first HEAD can start one. The segment up to that HEAD is skipped in one go
    and never tried again, where plain backtracking would rescan it for every HEAD.
    """
    return rf"((?:\A|\)){skip_head})({head}{body}[^)]*+)"


_LOOP = _one_per_segment(
    head=rf"for{BLANK}*+\(",
    skip_head=rf"(?:[^)f]++|f(?!or{BLANK}*+\())*+",
    body=r"(?:[^).]++|\.(?!length))*+\.length",
)
_BLOCK_VALUE = r"lock\.(?:timestamp|difficulty|number|blockhash)"
_ENCODED = rf"eccak256{BLANK}*+\({BLANK}*+abi\.encodePacked{BLANK}*+\("
_RANDOM = _one_per_segment(
    head="k" + _ENCODED,
    skip_head=rf"(?:[^)k]++|k(?!{_ENCODED}))*+",
    body=rf"(?:[^)b]++|b(?!{_BLOCK_VALUE}))*+b{_BLOCK_VALUE}",
)

# The same idea for SA-010: its match runs from an "address" to the next "=", on one
# line, and what follows the "=" decides for every "address" ahead of it. A segment
# starts at a line feed, an "=" or the end of the match before.
_ADDRESS = (
    r"((?:\G|[=\n])(?:[^=\na]++|a(?:(?<=\wa)|(?!ddress(?!\w))))*+)"
    rf"(address(?!\w)[^=\n]*+={BLANK}*+_\w++{BLANK}*+;)"
)
# Blanks, operators, blanks: written so that a run of blanks is read one way only.
_OLD_COMPILER = rf"()(pragma{BLANK}++solidity{BLANK}++(?:[\^>=<~]++{BLANK}*+)?0\.[1-7]\.)"

# Rule ids, texts, severities, classifications, links and patterns.
RULES = [
    Rule(
        "SA-001", "Reentrancy Vulnerability",
        "An external call is made before state variables are updated. An attacker can re-enter the function and drain funds before balances are decremented.",
        "CRITICAL", "SWC-107", "CWE-841",
        "Apply the Checks-Effects-Interactions (CEI) pattern: update all state variables BEFORE any external call. Add OpenZeppelin's ReentrancyGuard modifier as a second layer of defence.",
        (
            "https://swcregistry.io/docs/SWC-107",
            "https://docs.openzeppelin.com/contracts/4.x/api/security#ReentrancyGuard",
            "https://consensys.github.io/smart-contract-best-practices/attacks/reentrancy/",
        ),
        r"\.call\s*\{\s*value\s*:",
    ),
    Rule(
        "SA-002", "tx.origin Used for Authentication",
        "tx.origin refers to the original external account that started the transaction. If a malicious contract tricks a user into calling it, tx.origin still passes the check while msg.sender would not.",
        "HIGH", "SWC-115", "CWE-287",
        "Replace all tx.origin authentication checks with msg.sender.",
        (
            "https://swcregistry.io/docs/SWC-115",
            "https://docs.soliditylang.org/en/latest/security-considerations.html#tx-origin",
        ),
        r"tx\.origin",
    ),
    Rule(
        "SA-003", "Floating Pragma",
        "Using a caret (^) or range pragma allows the contract to be compiled with any compatible compiler version, including future ones that may introduce breaking changes or new vulnerabilities.",
        "LOW", "SWC-103", "CWE-664",
        "Pin the pragma to an exact version: `pragma solidity 0.8.24;`",
        ("https://swcregistry.io/docs/SWC-103",),
        r"pragma\s+solidity\s+[\^>=]",
    ),
    Rule(
        "SA-004", "Unprotected selfdestruct",
        "selfdestruct() destroys the contract and forwards all Ether to a target address. Without access control an attacker can call it to steal funds and brick the protocol.",
        "CRITICAL", "SWC-106", "CWE-284",
        "Guard every selfdestruct call with a strict access-control modifier (e.g. onlyOwner). Consider whether selfdestruct is needed at all — it is deprecated in EIP-6049.",
        (
            "https://swcregistry.io/docs/SWC-106",
            "https://eips.ethereum.org/EIPS/eip-6049",
        ),
        r"\bselfdestruct\s*\(",
    ),
    Rule(
        "SA-005", "Block Timestamp Dependence",
        "block.timestamp can be manipulated by validators/miners within a ~15 second window. Using it as a source of randomness or for precise time logic is unsafe.",
        "MEDIUM", "SWC-116", "CWE-330",
        "Avoid block.timestamp for randomness. For time-locks a ±15s tolerance is usually acceptable; document the assumption explicitly.",
        ("https://swcregistry.io/docs/SWC-116",),
        r"block\s*\.\s*timestamp",
    ),
    Rule(
        "SA-006", "Delegatecall to Potentially Untrusted Contract",
        "delegatecall executes external code in the context of the calling contract, sharing its storage. If the target is user-controlled or upgradeable without care, an attacker can overwrite critical storage slots.",
        "HIGH", "SWC-112", "CWE-829",
        "Never pass a user-supplied address to delegatecall. If using a proxy pattern, use OpenZeppelin's TransparentUpgradeableProxy or UUPS and follow EIP-1967 storage slots.",
        (
            "https://swcregistry.io/docs/SWC-112",
            "https://eips.ethereum.org/EIPS/eip-1967",
        ),
        r"\.delegatecall\s*\(",
    ),
    Rule(
        "SA-007", "Unchecked Low-Level Call Return Value",
        "Low-level .call() returns (bool success, bytes memory data). If the return value is not checked, a failed call silently continues execution and the contract operates on an incorrect assumption of success.",
        "MEDIUM", "SWC-104", "CWE-252",
        "Always check the boolean return: `(bool ok,) = addr.call{value: v}(''); require(ok, 'call failed');`",
        ("https://swcregistry.io/docs/SWC-104",),
        r"\.call\s*[\(\{]",
    ),
    Rule(
        "SA-008", "Weak Pseudo-Random Number Generation",
        "Block attributes (timestamp, difficulty, blockhash) used as a randomness seed can be predicted or influenced by validators/miners, enabling exploitation of lotteries, NFT drops, or any randomness-dependent logic.",
        "HIGH", "SWC-120", "CWE-338",
        "Use Chainlink VRF v2 for verifiable on-chain randomness. Never use block variables as a PRNG seed.",
        (
            "https://swcregistry.io/docs/SWC-120",
            "https://docs.chain.link/vrf/v2/introduction",
        ),
        r"keccak256\s*\(\s*abi\.encodePacked\s*\([^)]*block\.(timestamp|difficulty|number|blockhash)",
        jvm_form=_RANDOM,
    ),
    Rule(
        "SA-009", "Deprecated Solidity Function",
        "suicide(), sha3(), and callcode() are deprecated aliases removed in modern Solidity. Their presence indicates outdated code that may also miss newer security features.",
        "LOW", "SWC-111", "CWE-477",
        "Replace: suicide() → selfdestruct(), sha3() → keccak256(), callcode() → delegatecall().",
        ("https://swcregistry.io/docs/SWC-111",),
        r"\b(suicide|sha3|callcode)\s*\(",
    ),
    Rule(
        "SA-010", "Missing Zero Address Validation",
        "An address state variable is assigned from a parameter without checking that it is not address(0). Accidentally setting a critical address to zero can permanently break the contract.",
        "MEDIUM", "SWC-131", "CWE-20",
        "Add `require(_addr != address(0), 'zero address');` before assigning critical address parameters.",
        ("https://swcregistry.io/docs/SWC-131",),
        r"\baddress\b[^=\n]*=\s*_\w+\s*;",
        jvm_form=_ADDRESS,
    ),
    Rule(
        "SA-011", "Integer Overflow Risk (Solidity < 0.8.0)",
        "Solidity versions below 0.8.0 do not revert on arithmetic overflow/underflow. Without SafeMath, a uint wraps silently (e.g. 0 - 1 = 2^256 - 1), enabling balance manipulation.",
        "HIGH", "SWC-101", "CWE-190",
        "Upgrade to Solidity 0.8.0+ (overflow protection is built-in). For legacy code use OpenZeppelin SafeMath.",
        (
            "https://swcregistry.io/docs/SWC-101",
            "https://docs.openzeppelin.com/contracts/4.x/api/utils#SafeMath",
        ),
        r"pragma\s+solidity\s+[\^>=<~]*\s*0\.[1-7]\.",
        jvm_form=_OLD_COMPILER,
    ),
    Rule(
        "SA-012", "Inline Assembly Usage",
        "Inline Yul/assembly bypasses Solidity's type system and safety checks. Errors in assembly are harder to detect and can corrupt storage, break invariants, or enable memory-safety bugs.",
        "MEDIUM", "SWC-127", "CWE-676",
        "Minimise assembly usage. Thoroughly document purpose, add unit tests, and consider formal verification for assembly blocks.",
        ("https://swcregistry.io/docs/SWC-127",),
        r"\bassembly\s*\{",
    ),
    Rule(
        "SA-013", "Hard-coded Ethereum Address",
        "A raw 20-byte hex address is hard-coded. If this address is ever compromised, the contract cannot be updated without a full redeployment.",
        "LOW", "SWC-134", "CWE-547",
        "Replace hard-coded addresses with constructor arguments or owner-settable state variables with appropriate access control.",
        ("https://swcregistry.io/docs/SWC-134",),
        r"\b0x[0-9a-fA-F]{40}\b",
    ),
    Rule(
        "SA-014", "Flash-Loan Price Oracle Manipulation",
        "getReserves() returns the current spot reserves of a Uniswap/Curve pool. A flash loan can move these reserves within one block, letting an attacker manipulate prices used by your protocol for critical calculations.",
        "HIGH", "custom", "CWE-284",
        "Use a TWAP (time-weighted average price) oracle — Uniswap V3 TWAP or Chainlink Price Feeds — instead of spot reserves. Never use getReserves() for liquidation, collateral, or token-issuance pricing.",
        (
            "https://docs.uniswap.org/concepts/protocol/oracle",
            "https://docs.chain.link/data-feeds",
            "https://blog.openzeppelin.com/secure-smart-contract-guidelines-the-dangers-of-price-oracles/",
        ),
        r"\bgetReserves\s*\(",
    ),
    Rule(
        "SA-015", "Unchecked Arithmetic Block",
        "Arithmetic inside an `unchecked {}` block skips the overflow/underflow protection added in Solidity 0.8.0. Silent wrapping in unchecked blocks has caused real-world exploits.",
        "MEDIUM", "SWC-101", "CWE-190",
        "Review every arithmetic operation inside unchecked blocks. Only use unchecked for gas optimisation when overflow is provably impossible (e.g. loop counters bounded by array length).",
        ("https://docs.soliditylang.org/en/latest/control-structures.html#checked-or-unchecked-arithmetic",),
        r"\bunchecked\s*\{",
    ),
    Rule(
        "SA-016", "Missing Event for Critical State Change",
        "A critical access-control address (owner, admin, governance) is updated without emitting an event. Off-chain monitors, multisig dashboards, and auditors rely on events to detect privilege changes.",
        "LOW", "custom", "CWE-778",
        "Emit a dedicated event whenever owner, admin, or governance addresses are changed: `emit OwnershipTransferred(oldOwner, newOwner);`",
        ("https://consensys.github.io/smart-contract-best-practices/development-recommendations/solidity-specific/event-monitoring/",),
        r"\b(owner|admin|governance)\s*=\s*\w",
    ),
    Rule(
        "SA-017", "Potential Signature Replay Attack",
        "ecrecover() is used for signature verification. Without a nonce and/or chain ID bound to the signed message, a valid signature can be reused across multiple calls or replayed on other EVM-compatible networks.",
        "HIGH", "SWC-121", "CWE-294",
        "Use EIP-712 typed structured data hashing with domain separator (chainId, verifyingContract) and a per-user nonce. OpenZeppelin's EIP712 and ECDSA libraries handle this correctly.",
        (
            "https://swcregistry.io/docs/SWC-121",
            "https://eips.ethereum.org/EIPS/eip-712",
            "https://docs.openzeppelin.com/contracts/4.x/api/utils#ECDSA",
        ),
        r"\becrecover\s*\(",
    ),
    Rule(
        "SA-018", "Denial of Service via Unbounded Loop",
        "A loop iterates over .length of a dynamic array that can grow without bound. With enough elements the transaction will exceed the block gas limit, permanently bricking the function.",
        "MEDIUM", "SWC-128", "CWE-834",
        "Use a pull-over-push pattern (recipients claim their own funds) or paginate iteration with an explicit limit parameter.",
        (
            "https://swcregistry.io/docs/SWC-128",
            "https://consensys.github.io/smart-contract-best-practices/attacks/denial-of-service/",
        ),
        r"for\s*\([^)]*\.length",
        jvm_form=_LOOP,
    ),
]


def solidity_rules() -> RulePack:
    return RulePack(RULES)
