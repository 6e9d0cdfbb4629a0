"""Declared types: the page payload, the raw snapshots and the star schema's tables."""

from __future__ import annotations

#: The payload's first listing, as far as features are read from it. Loosely typed leaves are text.
PROPERTY = """
 lastUpdate: string, multimedia: struct<photos: array<string>>, price: struct<value: double>,
 costs: struct<condominiumExpenses: string, heatingExpenses: string>, surface: string, surfaceValue: string,
 surfaceConstitution: struct<surfaceConstitutionElements: array<struct<constitution: string, floor: struct<value: string>,
  surface: string, percentage: double, commercialSurface: string, surfaceType: string>>>,
 availability: string, category: struct<name: string>, typologyValue: string, condition: string, bathrooms: string,
 bedRoomsNumber: string, rooms: string, roomsValue: string, kitchenStatus: string, garage: string,
 floor: struct<abbreviation: string, floorOnlyValue: string>, ga4features: array<string>,
 energy: struct<zeroEnergyBuilding: boolean, heatingType: string, class: string, epi: string, airConditioning: string>,
 location: struct<latitude: double, longitude: double, region: string, province: string, provinceId: string, city: string,
  macrozone: string, microzone: string, locality: string, address: string, streetNumber: string>,
 elevator: boolean, buildingUsage: struct<value: string>, buildingYear: string, floors: string, residentialUnits: string,
 workDates: string, workProgress: string,
 auction: struct<saleDateValue: string, modalityDeposit: string, saleType: string, saleState: struct<isAvailable: boolean>,
  minimumOffer: string, procedureNumber: string, auctionCourt: string, lotCategory: struct<id: int, name: string>>,
 cadastrals: array<struct<cadastral: string, cadastralInfo: string, subCadastral: string>>, caption: string, description: string"""

#: The payload's listing (props.pageProps.detailData.realEstate) without its properties.
REAL_ESTATE = """
 createdAt: bigint, isNew: boolean, luxury: boolean, title: string, advertiser: struct<agency: struct<label: string>>,
 mortgage: struct<mortgageWidget: struct<rates: array<struct<percent: int, rates: array<struct<year: int, rate: double>>>>>>"""

RAW_SNAPSHOTS = """listing_id bigint, listing_type string, province_name string, province_code string, parent_listing bigint,
 child_listings array<bigint>, data array<struct<html_source: string, scraping_date: string>>"""

PROVINCES = "Province string, Code string, Region string, Macroregion string"

LISTING_TYPES = ("rent", "auction", "sale")
