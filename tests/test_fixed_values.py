"""The fixed values that both the package and the oracle use, against literals."""

from __future__ import annotations

from ledgerlens import params
from ledgerlens.sources import tpch_adapter as adapter


def test_addresses_and_labels():
    assert params.ROUTER_ADDRESSES == (
        "0xce16F69375520ab01377ce7B88f5BA8C48F8D666",
        "0x492751eC3c57141deb205eC2da8bFcb410738630",
        "0xDC3D8e1Abe590BCa428a8a2FC4CfDbD1AcF57Bd9",
        "0xdf4fFDa22270c12d0b5b3788F1669D709476111E",
        "0xe6B3949F9bBF168f4E3EFc82bc8FD849868CC6d8",
    )
    assert (params.STATUS_EXECUTED, params.SIMPLIFIED_STATUS_RECEIVED) == ("executed", "received")
    assert (params.SERVICE_TOKEN_TRANSFERS, params.SERVICE_CONTRACT_CALLS) == ("Token Transfers", "GMP")
    assert (params.LABEL_SUCCEEDED, params.LABEL_FAILED) == ("Succeeded", "Failed")


def test_adapter_constants():
    assert adapter.ASSET_BY_RETURNFLAG == {"A": "usdc", "N": "weth", "R": "wbtc"}
    assert adapter.BRIDGE_DEST_CHAINS == ("osmosis", "cosmoshub", "Kava", "moonbeam")
    assert adapter.BRIDGE_SOURCE_CHAINS == ("Ethereum", "ethereum", "BSC", "Polygon", "Arbitrum", "Avalanche", "polygon")
    assert adapter.OTHER_ADDRESS == "0x1111111111111111111111111111111111111111"
    assert adapter.TRANSFER_DEST_CHAINS == ("osmosis", "Moonbeam", "fantom", "Celo", "kava")
    assert adapter.TRANSFER_SOURCE_CHAINS == ("Ethereum", "ethereum", "Polygon", "Arbitrum", "AVALANCHE", "binance")
