"""Notices as public tools write them, and comments of people that look like them; every second one
stands below a licence header of twenty lines.

The rules were written without these lists. At first they found 70 of 81 NOTICES and none of
BY_HAND; mended for that, they found 31 of 39 MORE_NOTICES and 2 of 40 MORE_BY_HAND, and were mended
once more. NEW_NOTICES and NEW_BY_HAND were written after that, and nothing was changed for them."""

from factloom.llm import handwritten, notices

NOTICES = """
// Code generated by protoc-gen-go. DO NOT EDIT.
// Code generated by deepcopy-gen. DO NOT EDIT.
// Code generated by MockGen. DO NOT EDIT.
// Code generated by "stringer -type=Pill"; DO NOT EDIT.
// Code generated by sqlc. DO NOT EDIT.
// Code generated by github.com/99designs/gqlgen, DO NOT EDIT.
// Code generated by mockery v2.14.0. DO NOT EDIT.
// Code generated by go-swagger; DO NOT EDIT.
// Code generated by go-bindata. (@generated) DO NOT EDIT.
// Code generated by goyacc -o expr.y.go expr.y. DO NOT EDIT.
// Code generated by easyjson for marshaling/unmarshaling. DO NOT EDIT.
// Code generated by ent, DO NOT EDIT.
// Code generated by Wire. DO NOT EDIT.
// <auto-generated>|//     This code was generated by a tool.|//     Runtime Version:4.0.30319.42000|//     Changes to this file may cause incorrect behavior and will be lost if|//     the code is regenerated.|// </auto-generated>
# Generated by Django 3.2.5 on 2021-07-14 10:21
# Generated by the gRPC Python protocol compiler plugin. DO NOT EDIT!
# Generated by the protocol buffer compiler.  DO NOT EDIT!
# This file was automatically generated by SWIG (http://www.swig.org).|# Version 4.0.2|#|# Do not make changes to this file unless you know what you are doing--modify|# the SWIG interface file instead.
// Generated from Hello.g4 by ANTLR 4.7.1
# Generated from JSON.g4 by ANTLR 4.9.2
// Generated by CoffeeScript 1.12.7
/* Generated by Cython 0.29.21 */
/* A Bison parser, made by GNU Bison 3.8.2.  */
/* A lexical scanner generated by flex */
/* C code produced by gperf version 3.1 */
/* Generated by re2c 1.0.3 */
/* AUTO GENERATED FILE - DO NOT MODIFY */
/* DO NOT MODIFY - generated file */
/** * Autogenerated by Thrift Compiler (0.13.0) * * DO NOT EDIT UNLESS YOU ARE SURE THAT YOU KNOW WHAT YOU ARE DOING */
/* Generated By:JavaCC: Do not edit this line. ParserTokenManager.java */
/* The following code was generated by JFlex 1.6.1 on 7/3/15 10:04 PM */
// Generated by the protocol buffer compiler.  DO NOT EDIT!|// source: addressbook.proto
# Form implementation generated from reading ui file 'main.ui'|#|# Created by: PyQt5 UI code generator 5.15.4|#|# WARNING! All changes made in this file will be lost!
# Resource object code|#|# Created by: The Resource Compiler for PyQt5 (Qt v5.15.2)|#|# WARNING! All changes made in this file will be lost!
/* Form generated from reading UI file 'mainwindow.ui'|** Created by: Qt User Interface Compiler version 5.12.8|** WARNING! All changes made in this file will be lost when recompiling UI file! */
/* Meta object code from reading C++ file 'window.h'|** Created by: The Qt Meta Object Compiler version 67 (Qt 5.12.8)|** WARNING! All changes made in this file will be lost! */
// This file is auto-generated by graphql-codegen. Do not edit manually.
/* eslint-disable */|// This file was automatically generated and should not be edited.
/* tslint:disable */|/* auto-generated by NAPI-RS */
// This file has been automatically generated by TypeChain. Do not edit.
# This file is auto-generated from the current state of the database. Instead|# of editing this file, please use the migrations feature of Active Record to|# incrementally modify your database.
# This file was automatically generated by sphinx-apidoc.
# This file was autogenerated by setuptools_scm|# don't change, don't track in version control
# This file is generated by numpy's setup.py|# It contains system_info results at the time of building this package.
# This file is autogenerated by pip-compile with python 3.8|# To update, run:
# This file was generated by 'versioneer.py' (0.18) from|# revision-control system data, or from the parent directory name of an|# unpacked source archive.
# coding: utf-8|# Code generated by Microsoft (R) AutoRest Code Generator.|# Changes may cause incorrect behavior and will be lost if the code is regenerated.
/* NOTE: This class is auto generated by OpenAPI Generator (https://openapi-generator.tech). * Do not edit the class manually. */
/* NOTE: This class is auto generated by the swagger code generator program. * https://github.com/swagger-api/swagger-codegen.git * Do not edit the class manually. */
// This file was generated by the JavaTM Architecture for XML Binding(JAXB) Reference Implementation, v2.2.8|// Any modifications to this file will be lost upon recompilation of the source schema.
/* This file is generated by jOOQ. */
// Generated by Dagger (https://dagger.dev).
// Generated code from Butter Knife. Do not modify!
// Generated by data binding compiler. Do not edit!
// Generated by view binder compiler. Do not edit!
/** Automatically generated file. DO NOT MODIFY */
/* AUTO-GENERATED FILE.  DO NOT MODIFY.|*|* This class was automatically generated by the aapt tool. It should not be modified by hand. */
// automatically generated by the FlatBuffers compiler, do not modify
/* automatically generated by rust-bindgen 0.59.2 */
// Generated using SwiftGen -- https://github.com/SwiftGen/SwiftGen
// Generated using Sourcery 1.0.0 -- https://github.com/krzysztofzablocki/Sourcery|// DO NOT EDIT
// GENERATED CODE - DO NOT MODIFY BY HAND
// @generated by protobuf-ts 2.0.7 with parameter long_type_string
/** * @generated SignedSource<<f2a9a1c7d3c8>> */
// Autogenerated from Pigeon (v3.2.3), do not edit directly.
/* parser generated by jison 0.4.18 */
// Generated automatically by nearley, version 2.20.1
/* This file is machine generated by javah */ /* DO NOT EDIT THIS FILE - it is machine generated */
# Generated by configure.  Do not edit.
# generated automatically by aclocal 1.16.1 -*- Autoconf -*-
# Makefile.in generated by automake 1.16.1 from Makefile.am.
# CMAKE generated file: DO NOT EDIT!|# Generated by "Unix Makefiles" Generator, CMake Version 3.16
// GENERATED BY THE COMMAND ABOVE; DO NOT EDIT|// This file was generated by swaggo/swag
# AUTOGENERATED! DO NOT EDIT! File to edit: 00_core.ipynb (unless otherwise specified).
-- This file was generated by TableGen. Do not edit.
; This file was generated by the build script, changes will be overwritten
# Diese Datei wurde automatisch generiert. Nicht bearbeiten!
// Ce fichier a été généré automatiquement, ne pas modifier
// Este archivo fue generado automáticamente. No editar.
// このファイルは自動生成されました。編集しないでください。
// 此文件由 protoc 自动生成，请勿修改
""".strip().split("\n")  # fmt: skip

BY_HAND = """
# Helpers for the code generator: they decide which classes get a stub.
# The daily report is generated by cron every night, don't edit it by hand.
// Generated ids start at 1000, smaller ones are reserved.
// Code generated by this module goes to gen/ and is compiled there.
# Do not edit this file without asking the platform team.
# DO NOT EDIT the production values here; use the override file.
// Don't change the order of these constants, clients depend on it.
// Created by Jane Doe on 12/03/19.
// Created by IntelliJ IDEA. User: jane Date: 3/4/20
# Created with PyCharm by sam
/* Written by hand for speed; see the benchmark in docs. */
// This file is part of the billing service.
// This module generates the Go bindings from the schema.
# This script generates protobuf code with protoc and checks it in.
# Generates src/gen/*.py; run it after changing a .proto file.
# Wrapper around the generated client, which lives in gen/.
// Files with the @generated tag are skipped by the formatter.
// Skips files that say "Code generated ... DO NOT EDIT".
// Parses the automatically generated names that the compiler leaves.
# Automatically generated passwords are twelve characters long.
# Auto-generated ids are negative, so they never clash with real ones.
# Tokens are generated by the server at login and valid for an hour.
# The tables below were computed by hand from the data sheet.
// Copyright 2020 The Authors. All rights reserved.
// Licensed under the Apache License, Version 2.0 (the "License");
# SPDX-License-Identifier: MIT
# This file is part of the mail gateway, which is free software under the GPL version 3.
// Part of the search team's library. See LICENSE for terms.
/* Rebuild the index after changing anything in here. */
# Run this script again whenever the schema changes.
# Re-run after editing config.yml, changes are picked up at start only.
# Never edit generated files; change the templates in tmpl/ instead.
# TODO: the docs are built by sphinx from these strings, keep them short.
// Built with love by the platform team.
// Made by the interns, summer 2019.
// Compiled patterns are cached, see below.
# Compiled by hand from RFC 3986, appendix B.
# Produced events go to the topic of the same name.
// Translated from the Fortran original by K. Miller, 1998.
# Converted from Perl in 2011, still looks like it.
// Adapted from an answer on the web, rewritten since.
# Loader for generated fixtures.
# Compares the generated code with the checked-in copy.
"""
BY_HAND = BY_HAND.strip().split("\n") + """
// A hand-written parser: no generator could express the recovery we need.
// A small lexer, made to be read.
/* The scanner below replaces the one generated by flex until 2018. */
# Tests for the stub generator.
# Checks that generated SQL stays the same; update with --bless.
# Settings for the generator of thumbnails.
// Command gen writes mock types for interfaces.
// Package wire builds messages by hand, without protoc.
/* Keep in sync with the code that protoc generates for Order. */
// Changes to this class must be reviewed by two people.
// Changes in this file may break clients that cache responses.
// Edits are merged by the server; lost updates are retried.
# Manual changes of the schema are recorded here.
# Warning: edit with care, the cron job reads this file.
# Note: this file must stay below 500 lines.
# Version 2.1 of the protocol, see docs/protocol.md
// v1.4 added the retry budget.
// From the design review: generated keys need a prefix.
# Generated output is compared line by line.
# generated at runtime, do not cache
# Sources: src/main.c, src/util.c - rebuilt by make all
# Exports what the generated module needs
// see also generator.go
""".strip().split("\n")  # fmt: skip

MORE_NOTICES = """
// Code generated by counterfeiter. DO NOT EDIT.
// Code generated by cmd/cgo; DO NOT EDIT.
// Code generated by informer-gen. DO NOT EDIT.
// Code generated by oapi-codegen version v1.11.0 DO NOT EDIT.
// Code generated by private/model/cli/gen-api/main.go. DO NOT EDIT.
// Code generated by vfsgen; DO NOT EDIT.
// Code generated by entc, DO NOT EDIT.
/* This file was generated by upbc (the upb compiler) from the input file google/protobuf/any.proto. Do not edit -- your changes will be discarded when the file is regenerated. */
// This file is generated by rust-protobuf 2.27.1. Do not edit
// This file was generated by the Gradle 'init' task.
// This is a generated file. Do not edit directly.
# This is an auto-generated Django model module.
# This file was automatically created by FeatureTools, manual edits will be lost
# THIS FILE IS AUTOMATICALLY GENERATED BY CARGO
# This file is automatically @generated by Cargo.|# It is not intended for manual editing.
# Autogenerated with DRAKON Editor 1.31
# Generated from protobuf file, with grpcio-tools 1.48
# This file has been generated by node-gyp. Do not modify it.
# This source code was auto-generated by wsdl, Version=4.0.30319.1.
// This source file was automatically generated by xsd, Version=2.0.50727.42.
// Generated by typings
// Generated by dts-bundle-generator v5.3.0
// This file is autogenerated by the command `make fix-copies`, do not edit.
// WARNING: This file is machine generated by fidlgen.
// WARNING: Please don't edit this file. It was generated by C++/WinRT v2.0.210806.1
/* WARNING: This file was put together by hand-eye coordination? No: automatically generated by genconfig */
/* Automatically generated by Haxe */
/* automatically generated by configure */
/* Generated by wayland-scanner 1.18.0 */
/* Generated by gdbus-codegen 2.68.4. DO NOT EDIT. */
/* This file is generated by glib-genmarshal, do not modify it. */
/* Created by mkenum.py. DO NOT EDIT */
/* generated from GMarkdownParser.vala, do not modify */
/* header auto-generated by pidl */
; ModuleID file generated by TableGen, DO NOT EDIT
-- Generated by Flyway desktop. Do not edit by hand.
# Fichier généré par un outil, toute modification sera perdue. Ne pas modifier.
// Dieser Code wurde von einem Tool generiert. Änderungen gehen verloren, nicht bearbeiten.
// Этот файл автоматически сгенерирован, не редактируйте его
""".strip().split("\n")  # fmt: skip

MORE_BY_HAND = """
# Generated columns need MySQL 5.7 or later.
# Generated by hand from the spec, keep the order.
// Automatically retries three times, then gives up.
// This code is called by generated parsers, keep its signature.
// This class is instantiated by generated code, do not rename it.
// This file is read by the generator before anything is built.
# This file was written in a hurry before the release.
# This module was created to break an import cycle.
# This script was made for the 2018 migration and can go.
# The config is generated from env vars at startup.
# The lock file is generated by poetry, commit it.
# The clients in this folder are built with love and protobuf.
// Do not modify state in here, the generated reducers do that.
// Do not edit while the importer runs.
// Don't touch: breaks the build on windows.
# Compiled extension modules are looked for first.
# Built-in rules come before those of the user.
# Made configurable since 2.4.
// Emitted once per request.
// Produces the header that the compiler plugin reads.
/* Written for the generator tests: a class with every kind of field. */
// Automatic generation of ids is off by default.
// Auto generation can be turned off with --no-gen.
# Autogenerate support for alembic: compares the metadata with the database.
# Custom template for generated migrations
// Created on a branch, merged in 2020.
// Created: 2019-04-02, changed: 2021-01-30
# Machine learning models are versioned by date.
# Machine written notes are imported as drafts.
# Edit config.tmpl and run make to change the defaults of the service.
// Returns the notice "automatically generated, do not edit".
// Based on ideas from ANTLR and bison, but written by hand.
// Parser for .proto files, no code of protoc is used.
// See LICENSE. This file is part of the server, version 3 and later.
// Copied from the old repository, cleaned up.
/* Taken from chapter 5.2 of the book, with their permission. */
# from version 1.2 on, redistributed entries count twice
# distributed lock with a lease of 2.5 seconds, see the notice board
# swagger docs are served from here
# uses django and alembic
""".strip().split("\n")  # fmt: skip

NEW_NOTICES = """
// Code generated by lister-gen. DO NOT EDIT.
// Code generated by goagen v1.3.0, DO NOT EDIT.
// Code generated by thriftgo (0.2.8). DO NOT EDIT.
// Code generated by Speakeasy (https://speakeasyapi.dev). DO NOT EDIT.
// Code generated by applyconfiguration-gen. DO NOT EDIT.
// File generated by our OpenAPI generator. See CONTRIBUTING.md for details.
// This file was auto-generated by Fern from our API Definition.
// This file is auto-generated by @hey-api/openapi-ts
// Automatically generated by the Fast Binary Encoding compiler, do not modify!
// This code was generated by AWS AppSync codegen, do not edit
// This file is generated by tools/gen_opcodes.py. Do not edit.
# generated by datamodel-codegen:|#   filename:  openapi.yaml
# This file is auto generated by scripts/update_tables.sh
# Generated by scripts/make_unicode.py from UnicodeData.txt
# Generated with protoc-gen-python_betterproto
# -*- coding: utf-8 -*-|# Autogenerated by Sphinx on Mon Dec  5 2022
# Auto-generated by cog, see build.cog
# Automatically produced by bumpversion. Any edits will be overwritten.
# DO NOT EDIT. Generated by utils/spm_list.sh
/* DO NOT EDIT THIS FILE: it is generated from settings.def */
/* This header is generated by vulkan_genvk from the XML registry. */
/* MACHINE GENERATED FILE, DO NOT EDIT */
/* This file has been autogenerated by libsquoze. */
/* Generated from ../src/op.dasc. DO NOT EDIT! */
/** Generated by Xtext 2.14.0, do not change it */
/* generated by Svelte v3.44.0 */
/* Generated by Kotlin Symbol Processing */
-- Automatically generated by pg_dump wrapper; do not edit
; Generated by LLVM tablegen. Do not modify manually.
// Automatycznie wygenerowany plik, nie edytować
""".strip().split("\n")  # fmt: skip

NEW_BY_HAND = """
# Generator for stub classes, see the manual.
# The code generator skips classes without fields.
# This class generates ids and never reuses one.
# This file lists the tables that are generated nightly.
# This function is called by code generated with cython.
# This package bundles the generated protobuf messages.
// This is a thin layer above the generated client.
// This file contains helpers for generated and written classes.
// This test checks the file generated by the exporter.
// It was written before the compiler could do this.
// Do not edit the templates, they are generated from the wiki.
// Don't edit in production, changes are lost on restart.
// Manual edits are merged with generated ones, manual ones win.
# Generated files are ignored by git, see .gitignore
# Generated traffic is marked by a header.
# Created by hand in 2012, cleaned up since.
# Created for the demo, not for production.
# Built by make, run by systemd.
# Produced by the finance team every quarter, read by us.
# Automatically closes stale connections.
# Automatically created accounts have no password.
# Auto-created indexes are dropped at the end.
// Machine-readable errors, one per line.
// Compiles the regular expressions of the config file.
// Written by the compiler group, reviewed by everyone.
// Translation of the 1998 C code, with its comments.
// Tool for comparing two generated trees.
// Grammar tests, ANTLR must be on the path.
/* Parser made simple: one function per rule. */
/* Version 1.2 of this file dropped support for python 2. */
""".strip().split("\n")  # fmt: skip

LICENCE = """Copyright 2019 The Quarry Authors.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.

This product includes software developed at the Quarry Foundation
(http://quarry.example/). It also includes parts that were written for
the first release and have been kept since then, as they still work,
which nobody expected of them when they were put into this place first.
""".split("\n")
CODE = "\nvalue = total(rows)\n\nfor x in rows:\n    if x.price > 3:\n        add(x, value)\n"


def sign(line):
    return next((s for s in ("//", "#", "--", ";") if line.startswith(s)), "//")


def text(line, below):
    head = "\n".join(f"{sign(line)} {x}" for x in LICENCE) + "\n\n" if below else ""
    return head + line.replace("|", "\n") + "\n" + CODE


def test_notices_of_public_tools():
    missed = [x for k, x in enumerate(NOTICES + MORE_NOTICES + NEW_NOTICES) if handwritten.text_kind(text(x, k % 2)) != "generated"]
    assert len(NOTICES) >= 60 and len(missed) <= 0.05 * len(NOTICES + MORE_NOTICES + NEW_NOTICES), missed


def test_comments_of_people():
    false = [x for k, x in enumerate(BY_HAND + MORE_BY_HAND + NEW_BY_HAND) if handwritten.text_kind(text(x, k % 2)) is not None]
    assert len(BY_HAND) >= 60 and len(false) <= 0.02 * len(BY_HAND + MORE_BY_HAND + NEW_BY_HAND), false


def test_headers():
    assert notices.header(["#!/bin/sh", "# a", "#", "# b", "", "x=1", "# c"]) == [["a"], ["b"]]
    assert notices.header(["/*", " * a", " */", "package p", "", "// b", "func f() {", "// c"]) == [["a"], ["b"]]
    assert notices.header(['"""Doc."""', "import x", "y = 1"]) == [["Doc."]]
    assert notices.header([]) == notices.footer([]) == notices.header([""]) == []
    assert notices.footer(["x", "// a", "", "// b"]) == [["a", "b"]]
    assert notices.header(["// " + "x" * 100_000] * 30)[0][29] == "x" * 100_000


def test_third_party_headers():
    third = [
        "/*! jQuery v3.5.1 | (c) JS Foundation and other contributors | jquery.org/license */",
        "/**\n * @license\n * Lodash 4.17.15 <https://lodash.com/>\n * Released under MIT license\n */",
        "// This file is part of tinyxml 2.6.2.\n// Redistribution and use in source and binary forms are permitted.",
        "# Copied from six 1.16.0, which is released under the MIT license.",
        "# Vendored from the retrying package, version 1.3.3. See LICENSE for terms.",
    ]
    own = ["// Copyright of the catalog team. Part of catalog-service, all rights reserved.", "# This file is part of GNU Emacs.\n# GNU Emacs is free software, see the GNU General Public License, version 3.0.", "# Licensed under the Apache License, Version 2.0"]
    assert [handwritten.text_kind(x + "\n" + CODE) for x in third] == ["vendored"] * len(third)
    assert [handwritten.text_kind(x + "\n" + CODE) for x in own] == [None] * len(own)


def test_layout_alone_is_no_evidence():
    constants = "".join(f"{n}_LIMIT = {i * 7}  # how many {n.lower()}s one account may have\n" for i, n in enumerate("USER ROLE TEAM NOTE FILE MAIL CALL TASK LINE PAGE ITEM SLOT RULE VIEW JOB TAG KEY BOX ROW COL".split()))
    assert handwritten.text_kind(constants) is None
    switch = "switch (m) {\n" + "".join(f"case {i}: return label({w!r}, {i * 3});\n" for i, w in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())) + "}\n"
    assert handwritten.text_kind(switch) is None
    assert handwritten.text_kind("\n".join(f"case {i}: goto st{i * 7 % 40}; // {i * 3}" for i in range(40))) == "generated"
